"""Operators for preparing training corpora; nothing else in the library imports this folder.

Functions that run in Python workers travel whole, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
