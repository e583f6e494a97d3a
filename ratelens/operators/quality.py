"""Row and column filters (C-3, C-5 .. C-8, C-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SENTINEL, SPARSE_COLUMNS
from ..functions.cleaning import check_columns


def drop_columns(df: DataFrame, columns: Sequence[str] = SPARSE_COLUMNS) -> DataFrame:
    """C-3: drop named sparse columns (absent names are ignored, as in Spark)."""
    return df.drop(*columns)


def known(df: DataFrame, col: str, token: str = SENTINEL) -> DataFrame:
    """C-5: keep rows with a known category (not NULL and not the token)."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != token))


def prescribed(df: DataFrame, medication: str, absent: str = "No") -> DataFrame:
    """C-6: rows where the medication status is not 'No' (SQL meaning: a
    NULL status is dropped)."""
    return df.filter(F.col(medication) != absent)


def at_most(df: DataFrame, col: str, bound: float) -> DataFrame:
    """C-7: upper-bound filter; pushed into the Parquet scan when ``col`` is stored."""
    return df.filter(F.col(col) <= bound)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C-8: rows with no NULL in ``columns``."""
    check_columns("complete_cases", df, *columns)
    return df.dropna(subset=list(columns))


def complete_case_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C-8 report: total, kept and dropped rows in one aggregate."""
    check_columns("complete_case_report", df, *columns)
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return (df.agg(F.count(F.lit(1)).alias("total_rows"),
                   F.count_if(complete).alias("kept_rows"))
            .withColumn("dropped_rows", F.col("total_rows") - F.col("kept_rows")))


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C-10: NULL to 0 in numeric columns (all, or the given ones)."""
    return df.fillna(0, subset=list(columns)) if columns else df.fillna(0)
