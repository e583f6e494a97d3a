"""Profiling operators (B-1 .. B-10).

Each per-column profile is a single aggregate pass over the data: one
aggregate per column, packed into an array of structs and turned into rows
with ``inline``. The row count of the result equals the number of columns,
whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import SENTINEL
from ..functions.flags import event_flag


def preview(df: DataFrame, n: int = 10, order: str = "encounter_id") -> DataFrame:
    """B-1: first ``n`` rows in a fixed order (a bare LIMIT is not deterministic)."""
    return df.orderBy(order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """B-2: one row with the row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)))


def _per_column(df: DataFrame, value_name: str,
                agg: Callable[[str, T.DataType], Column]) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(f.dataType.simpleString()).alias("data_type"),
                      agg(f.name, f.dataType).alias(value_name))
             for i, f in enumerate(df.schema.fields)]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def describe_columns(df: DataFrame) -> DataFrame:
    """B-3: position, name, type and non-null count of every column."""
    return _per_column(df, "non_null", lambda c, _t: F.count(F.col(c)))


def _top(prof: DataFrame, value: str, top: int | None) -> DataFrame:
    out = prof.select("column", value).orderBy(F.col(value).desc(), F.col("column"))
    return out.limit(top) if top is not None else out


def null_profile(df: DataFrame, top: int | None = 10) -> DataFrame:
    """B-4: NULL count per column, largest first (ties by name), top ``top``."""
    prof = _per_column(df, "null_count",
                       lambda c, _t: F.count_if(F.col(c).isNull()))
    return _top(prof, "null_count", top)


def sentinel_profile(df: DataFrame, token: str = SENTINEL, top: int | None = 15) -> DataFrame:
    """B-5: count of cells equal to ``token`` per column (0 for non-text)."""
    def count_token(c: str, t: T.DataType) -> Column:
        if isinstance(t, T.StringType):
            return F.count_if(F.col(c) == token)
        return F.lit(0).cast("bigint")
    return _top(_per_column(df, "sentinel_count", count_token), "sentinel_count", top)


def missing_percent(df: DataFrame, top: int | None = 10) -> DataFrame:
    """B-6: percent of NULL cells per column, largest first, top ``top``."""
    prof = _per_column(df, "missing_pct", lambda c, _t: F.avg(
        F.when(F.col(c).isNull(), 1).otherwise(0)) * 100.0)
    return _top(prof, "missing_pct", top)


def value_counts(df: DataFrame, col: str, drop_null: bool = True,
                 count_name: str = "count") -> DataFrame:
    """B-7: category distribution, largest first. ``drop_null`` follows the
    pandas form; the SQL form keeps a NULL group."""
    src = df.filter(F.col(col).isNotNull()) if drop_null else df
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
            .orderBy(F.col(count_name).desc(), F.col(col)))


def total_count(df: DataFrame, name: str = "total_patients") -> DataFrame:
    """B-8: total row count."""
    return df.agg(F.count(F.lit(1)).alias(name))


def global_mean(df: DataFrame, col: str = "time_in_hospital", name: str = "avg_los") -> DataFrame:
    """B-9: mean of one measure."""
    return df.agg(F.avg(col).alias(name))


def overall_rate(df: DataFrame, event: Column | None = None,
                 name: str = "readmission_rate") -> DataFrame:
    """B-10: overall event rate, computed (never a constant)."""
    return df.agg(F.avg(event_flag() if event is None else event).alias(name))
