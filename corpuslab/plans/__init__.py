"""Registered queries over the driver tables, by subject."""

from corpuslab.plans import (  # noqa: F401  (importing registers the queries)
    classes, clusters, corpus, evaluation, learning, planted, sources, sparse, text, vectors,
)
from corpuslab.plans.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
