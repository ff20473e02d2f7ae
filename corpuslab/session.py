"""Session helpers: shared scratch space, stored intermediate tables, scopes that clear them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Number of tasks that small input tables are dealt over; unset: as Spark reads them.
INPUT_SETTING = "corpuslab.input.partitions"


def local_session(app_name: str, cores: str | int = "*", scratch: str | None = None, **settings: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the caller brings its own.

    ``scratch`` is the folder for stored tables; all tables are dealt over eight tasks, as
    the test tables are single files.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(INPUT_SETTING, "8")
    )
    if scratch:
        builder = builder.config(CHECKPOINT_SETTING, scratch)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named in ``spark.checkpoint.dir``."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if not configured:
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    return configured


_OPEN_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A path below the shared folder that no other run uses.

    It belongs to the innermost open scope, or with ``outlive`` to the one around that.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scopes = _OPEN_SCOPES[:-1] if outlive else _OPEN_SCOPES
    if scopes:
        scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove, on leaving, all that was stored inside; use the results before that."""
    paths: list[str] = []
    _OPEN_SCOPES.append(paths)
    try:
        yield
    finally:
        _OPEN_SCOPES[:] = [p for p in _OPEN_SCOPES if p is not paths]
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            place = hadoop(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; see :func:`scratch_path` for ``outlive``.

    Later uses start from the stored table, so they neither repeat the work
    nor depend on executors that may be gone, and the optimizer sees its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, outlive)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an input table by hash over as many tasks as the session names, if it names any."""
    parts = df.sparkSession.conf.get(INPUT_SETTING, None)
    return df.repartition(int(parts), *[F.col(k) for k in keys]) if parts else df


@contextmanager
def persisted(df: DataFrame):
    """Keep ``df`` cached while a multi-pass fit reads it."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
