"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: a word is a run of characters other than these six separators
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def sealed(df: DataFrame) -> DataFrame:
    """The rows with columns c0, c1, ...: no name of the input can clash with an operator's."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """Name in ``sealed(df)`` of a column of df."""
    names = [c.lower() for c in df.columns]
    return f"c{df.columns.index(name) if name in df.columns else names.index(name.lower())}"


def unsealed(df: DataFrame) -> list[Column]:
    """Columns of ``sealed(df)`` under their own names."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
