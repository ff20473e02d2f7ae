"""How far fitted regression coefficients are from the optimum, from the training rows alone.

The penalised loss is convex, so coefficients are optimal exactly if its gradient vanishes, or,
where an L1 penalty makes a kink at 0, if 0 lies between the slopes on both sides. Nothing
of the solver is needed: one aggregation by slot gives the gradient.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.layers import BIAS, predict


def violations(rows: DataFrame, id_column: str, label: str, layer: DataFrame, labels: Sequence[str],
               reg: float, elastic_net: float) -> DataFrame:
    """(class, slot, coefficient, violation): by how much each condition fails; slot -1 is the intercept.

    The mean loss has the penalty ``reg * (elastic_net * L1 + (1 - elastic_net) / 2 * L2)`` on
    coefficients of slots scaled to unit deviation, intercepts free. Slots that no row has are
    left out, as are slots of one value, which have no scale. ``rows`` has slots, values and
    unique ids; labels that were not seen in training must not occur.
    """
    position = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(label)).cast("int")
    n = rows.count()
    likely = predict(rows, id_column, [layer], labels).select(F.col(id_column).alias("__id"), "probability")
    own = rows.select(id_column, "slots", "values", position.alias("__own")).join(likely, F.col(id_column) == F.col("__id"))
    # what the model says too much of each class
    excess = F.transform("probability", lambda p, k: p - F.when(k + 1 == F.col("__own"), 1.0).otherwise(0.0))
    entries = own.select(excess.alias("excess"), F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(BIAS)), F.col("slots").cast("array<int>")).alias("slot"),
        F.concat(F.array(F.lit(1.0)), F.col("values")).alias("value"))).alias("e"))
    slots = entries.groupBy(F.col("e.slot").cast("long").alias("slot")).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.transform("excess", lambda x: x * F.col("e.value"))))).alias("slope"),
        F.sum("e.value").alias("total"), F.sum(F.col("e.value") * F.col("e.value")).alias("squares"))
    variance = (F.col("squares") - F.col("total") * F.col("total") / n) / max(n - 1, 1)
    scale = F.when(F.col("slot") == BIAS, F.lit(1.0)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))
    joined = slots.withColumn("scale", scale).where("scale > 1e-12").join(layer, "slot")
    each = joined.select("slot", "scale", F.posexplode(F.arrays_zip("weights", "slope")).alias("k", "w"))
    weight, slope = F.col("w.weights") * F.col("scale"), F.col("w.slope") / n / F.col("scale")
    l1, l2 = reg * elastic_net, reg * (1 - elastic_net)
    failed = F.when(F.col("slot") == BIAS, F.abs(slope)).when(
        weight == 0, F.greatest(F.abs(slope) - l1, F.lit(0.0))).otherwise(F.abs(slope + l2 * weight + l1 * F.signum(weight)))
    return each.select(F.element_at(F.array(*[F.lit(c) for c in labels]), F.col("k") + 1).alias("class"), "slot",
                       F.col("w.weights").alias("coefficient"), failed.alias("violation"))


def certificate(found: DataFrame) -> DataFrame:
    """Per class: conditions looked at, coefficients other than 0, and the worst violation."""
    is_slot = F.col("slot") != BIAS
    return found.groupBy("class").agg(
        F.count_if(is_slot).alias("n_slots"), F.count_if(is_slot & (F.col("coefficient") != 0)).alias("n_nonzero"),
        F.max("violation").alias("worst"))
