"""Compare registered queries with their SQL text on one folder of tables.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


_KINDS = {
    "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
}


def differences(name: str, frame, connection, sql: str) -> list[str]:
    """What differs in columns, types and rows; empty when all is equal."""
    found = []
    relation = connection.sql(sql)
    if sorted(frame.columns) != sorted(relation.columns):
        return [f"{name}: columns {sorted(frame.columns)} and {sorted(relation.columns)}"]
    types = dict(zip(relation.columns, map(str, relation.types)))
    for column, kind in frame.dtypes:
        if _KINDS.get(kind) != types[column]:
            found.append(f"{name}: {column} is {kind}, SQL gives {types[column]}")
    spark_rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    sql_rows = _rows(relation.columns, relation.fetchall())
    if spark_rows != sql_rows:
        only_spark = list((spark_rows - sql_rows).items())
        only_sql = list((sql_rows - spark_rows).items())
        found.append(
            f"{name}: {spark_rows.total()} and {sql_rows.total()} rows, "
            f"{len(only_spark)} / {len(only_sql)} unmatched, "
            f"e.g. {str(only_spark[:2])[:300]} and {str(only_sql[:2])[:300]}"
        )
    return found


def main() -> int:
    from corpuslab.plans import QUERIES
    from corpuslab.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session("compare", 8, scratch=tempfile.mkdtemp(prefix="compare-"))
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(sf_dir)
    failed = 0
    for name in chosen:
        q = QUERIES[name]
        start = time.perf_counter()
        try:
            frame = q.plan(spark, sf_dir)
            if q.sql is None:
                message = [] if (n := frame.count()) else [f"{name}: no rows"]
                note = f"{n} rows, no SQL"
            else:
                message = differences(name, frame, connection, q.sql)
                note = "equal"
        except Exception as error:  # report and go on with the next query
            message, note = [f"{name}: {type(error).__name__} {str(error)[:600]}"], ""
        failed += bool(message)
        print(f"{time.perf_counter() - start:7.2f}s {name}: {' | '.join(message) or note}", flush=True)
    print(f"{len(chosen)} queries, {failed} failed")
    return bool(failed)


if __name__ == "__main__":
    raise SystemExit(main())
