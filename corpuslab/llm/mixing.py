"""Mixing sources to target weights with a curriculum that changes over training.

Each source gets a target in words and is read as a stream: its documents in hashed order,
again from the start up to three times. A source's weight may change over training; the
integral of its schedule says how many of its words are due at a time, and its inverse gives
each document in the stream its position. Documents are then sorted by position.

Running sums are taken in two levels, over hash buckets and inside them, so a source with a
third of all rows is spread over all tasks. Only the table of sources is handled in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.numbering import numbered

# Words, weights by rank, and the most often a source is repeated.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
BUCKET_DIGITS = 3  # hex digits of the hash that name a bucket
ADDED = ["size", "source_size", "target", "taken", "copies"]
_INNER = ["_key", "_bucket", "_before", "_source"]

# Relative weight over training: (time from 0 to 1, weight), linear in between.
Schedule = Sequence[tuple[float, float]]
STEADY: Schedule = ((0.0, 1.0), (1.0, 1.0))
BY_RANK: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    STEADY,
    ((0.0, 0.5), (1.0, 1.5)),
)


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words, and the key that orders each source's stream.

    Null texts have none. Columns of these names (``size``, ``_key``) are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c not in {"size", "_key"}]
    return docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.col(id).cast("string"), F.col(text))).alias("_key"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rank) from (source, source_size); null is a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at three
    times its source's size and the excess is shared again by weight: all others get the
    same multiple of their weight, found from running sums in order of that limit.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", MOST_TIMES * F.col("source_size"))
    every = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn(
        "level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0))))
    first = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level")), ignorenulls=True).over(first)
    return ranked.withColumn("common", level).select(
        "source", "source_size", "rank",
        F.coalesce(F.least(F.col("common") * F.col("weight"), F.col("limit").cast("double")),
                   F.col("limit").cast("double")).alias("target"))


def planned(rows: DataFrame, source: str = "source") -> DataFrame:
    """Rows of :func:`sized` with ``source_size``, ``target``, ``copies`` and ``taken``.

    A copy is taken if its middle lies before the target in the source's stream, so a source
    is met to within one document. Copies never exceed three; a document without words is
    never taken. Order and result depend on ids and texts alone; equal rows are told apart
    by nothing, so it does not matter which of them is taken. Null ids and texts are fine.
    """
    kept = [c for c in rows.columns if c not in {*ADDED[1:], *_INNER[1:], "_rank"}]
    placed = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(source).alias("_source"),
                         F.substring("_key", 1, BUCKET_DIGITS).alias("_bucket"))
    buckets = placed.groupBy("_source", "_bucket").agg(F.sum("size").alias("bucket_size"))
    sources = source_targets(buckets.groupBy(F.col("_source").alias("source")).agg(F.sum("bucket_size").alias("source_size")))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    buckets = buckets.join(sources, F.col("_source").eqNullSafe(F.col("source"))).select(
        F.col("_source").alias("b_source"), F.col("_bucket").alias("b_bucket"), "bucket_before",
        "source_size", "target", F.col("rank").alias("_rank"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(buckets, F.col("_source").eqNullSafe(F.col("b_source")) & (F.col("_bucket") == F.col("b_bucket")))
    start = F.col("_inside") + F.col("bucket_before")
    middle = start + F.col("size") / 2
    copies = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(MOST_TIMES), F.ceil(
        (F.col("target") - middle) / F.col("source_size")))).cast("int"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).cast("long").alias("taken"), middle.alias("_before"), "_rank")


def _integral(schedule: Schedule) -> list[float]:
    """Share of a source's words due by each knot."""
    total = [0.0]
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        total.append(total[-1] + (b - a) * (v + w) / 2)
    return [x / total[-1] for x in total]


def position(share: Column, schedule: Schedule) -> Column:
    """Time at which the given share (0 to 1) of a source's words is due: the inverse integral."""
    due = _integral(schedule)
    scale = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:]))
    result = F.lit(schedule[-1][0])
    for k in range(len(schedule) - 2, -1, -1):
        (a, v), (b, w) = schedule[k], schedule[k + 1]
        v, w = v / scale, w / scale
        rest, slope = share - due[k], (w - v) / (b - a)
        if abs(slope) < 1e-12:
            inside = a + rest / v if v else F.lit(a)
        else:  # v * x + slope * x^2 / 2 = rest
            inside = a + (F.sqrt(F.greatest(v * v + 2 * slope * rest, F.lit(0.0))) - v) / slope
        result = F.when(share < due[k + 1], inside).otherwise(result)
    return result


def copies_in_time(plan: DataFrame, schedules: Mapping[str | None, Schedule] | None = None, source: str = "source") -> DataFrame:
    """One row per copy that the mix takes of the rows of :func:`planned`: ``_copy`` from 0, and ``_at``,
    the time from 0 to 1 at which the source's schedule has it due.

    ``schedules`` gives weights over time by source, others take :data:`BY_RANK` in turn.
    """
    copy = plan.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("_before") + F.col("_copy") * F.col("source_size")) / F.col("target")
    at = F.when(F.col("_rank") % len(BY_RANK) == 0, position(share, BY_RANK[0]))
    for k, schedule in enumerate(BY_RANK[1:], start=1):
        at = at.when(F.col("_rank") % len(BY_RANK) == k, position(share, schedule))
    own = None
    for name, schedule in (schedules or {}).items():
        is_it = F.col(source).isNull() if name is None else F.col(source) == name
        own = F.when(is_it, position(share, schedule)) if own is None else own.when(is_it, position(share, schedule))
    return copy.withColumn("_at", at if own is None else F.coalesce(own, at))


def sequenced(plan: DataFrame, schedules: Mapping[str | None, Schedule] | None = None, source: str = "source") -> DataFrame:
    """Rows of :func:`planned` with ``first_at`` and ``first_place``: time of the first copy, and its
    place from 0 among all copies of the mix in training order. Null for rows that are not taken."""
    kept = [c for c in plan.columns if c not in {"first_at", "first_place"}]
    placed = numbered(copies_in_time(plan, schedules, source), [F.col("_at"), F.col("_key"), F.col("_copy")], "_place")
    taken = placed.where("_copy = 0").select(*kept, F.col("_at").alias("first_at"), F.col("_place").alias("first_place"))
    rest = plan.where("copies = 0").select(
        *kept, F.lit(None).cast("double").alias("first_at"), F.lit(None).cast("long").alias("first_place"))
    return taken.unionByName(rest)


def mix(docs: DataFrame, schedules: Mapping[str | None, Schedule] | None = None, id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position.

    Columns are those of ``docs``, values too, whatever their names; each copy of a document has
    its own position. Null texts and texts without words are never taken, null sources are one
    source, null ids and repeated rows are as good as others; ties in position go by a hash of id
    and text. An empty table gives no rows. Texts count whole, however long.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id}`").alias("id"),
                         F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    placed = copies_in_time(planned(sized(packed, "id", "text").drop("text")), schedules)
    ordered = placed.repartitionByRange("_at", "_key").sortWithinPartitions("_at", "_key")
    return ordered.select("_doc.*")
