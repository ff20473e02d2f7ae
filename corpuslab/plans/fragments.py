"""SQL fragments shared by the check texts."""

from __future__ import annotations


def unit(column: str, seed: int | None = None) -> str:
    value = f"{column}::VARCHAR" if seed is None else f"'{seed}:'||{column}::VARCHAR"
    return f"(('0x'||substr(md5({value}),1,8))::BIGINT / 4294967296::DOUBLE)"


def bucket(column: str, buckets: int) -> str:
    return f"(('0x'||substr(md5({column}),1,8))::BIGINT % {buckets})"


def tokens(column: str) -> str:
    return rf"string_split_regex(regexp_replace(lower({column}),'\s+$',''),'\s')"


def without_tags(column: str) -> str:
    return f"regexp_replace({column},'<.*?>','','g')"


def class_table(table: str, column: str) -> str:
    return (
        f"SELECT {column}, count(*) AS n, count(*)/(sum(count(*)) OVER ()) AS share, "
        f"row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS class_index "
        f"FROM {table} GROUP BY {column}"
    )
