"""Cleaning a corpus and auditing its missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from corpuslab.functions.text import has_content, is_blank, remove_accents, strip_tags


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns})


def strip_tag_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: strip_tags(F.col(c)) for c in columns})


def remove_accent_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: remove_accents(F.col(c)) for c in columns})


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither empty nor null."""
    return df.where(F.col(column) != "")


def clean_corpus(df: DataFrame, text_columns: Sequence[str], class_columns: Sequence[str] = (),
                 required: str | None = None) -> DataFrame:
    """Trim, strip tags (text only), remove accents; rows whose ``required`` is blank then go.

    Blank rows are recognised before the accent step. A filter on its result
    would run that step, Python included, a second time.
    """
    if required:
        df = df.where(has_content(F.col(required)))
    df = trim_columns(df, [*text_columns, *class_columns])
    df = strip_tag_columns(df, text_columns)
    return remove_accent_columns(df, [*text_columns, *class_columns])


def clean_class_counts(df: DataFrame, class_column: str, required: str) -> DataFrame:
    """Rows per cleaned class name, of rows whose ``required`` text is not blank.

    Raw names are counted first, so only one row per name goes through cleaning.
    """
    raw = df.where(has_content(F.col(required))).groupBy(class_column).agg(F.count(F.lit(1)).alias("__n"))
    clean = remove_accent_columns(trim_columns(raw, [class_column]), [class_column])
    return clean.groupBy(class_column).agg(F.sum("__n").alias("n")).orderBy(F.col("n").desc(), class_column)


def corpus_of(df: DataFrame, text_column: str, keep: Sequence[str]) -> DataFrame:
    """Corpus over one choice of text column (body, summary or title), blanks dropped."""
    return drop_blank(df, text_column).select(*keep, F.col(text_column).alias("text"))


def label_features(df: DataFrame, label: str, features: str) -> DataFrame:
    return df.select(F.col(label).alias("label"), F.col(features).alias("features"))


def count_blank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in columns])


def null_audit(df: DataFrame) -> DataFrame:
    """Null or NaN values per column, as one row.

    NaN exists in floating-point columns only; ``isnan`` on text is an error
    under ANSI rules.
    """
    def missing(field):
        column = F.col(field.name)
        if isinstance(field.dataType, (DoubleType, FloatType)):
            return column.isNull() | F.isnan(column)
        return column.isNull()

    return df.agg(*[F.count_if(missing(f)).alias(f.name) for f in df.schema.fields])
