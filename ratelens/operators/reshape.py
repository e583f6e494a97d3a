"""Pivots and wide-to-long reshapes (H-1 .. H-7, H-9, C-14).

Pivots always get explicit column values where the domain is known, which
avoids Spark's extra distinct job and keeps the schema stable when a
category is absent from the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import KPI_LABELS
from ..functions.flags import bracket_order, event_flag
from ..functions.formatting import fixed, percent, thousands


def pivot_rate(df: DataFrame, index: str, columns: str, values: Sequence,
               event: Column | None = None, other: str = "other") -> DataFrame:
    """H-1: mean event rate for each (index, column value) as a wide frame.

    ``values`` lists the column values (and their order); all further values
    are pooled in the column ``other``, so no row is lost and the schema
    does not depend on the data.
    """
    ev = event_flag() if event is None else event
    value = F.col(columns)
    cell = F.when(value.isNotNull(), F.lit(other))
    for v in values:
        cell = F.when(value == F.lit(v), F.lit(str(v))).otherwise(cell)
    return (df.withColumn("__cell", cell).groupBy(index)
            .pivot("__cell", [*map(str, values), other]).agg(F.avg(ev)).orderBy(index))


def pivot_table(long: DataFrame, index: str, columns: str, value: str,
                values: Sequence[str], row_domain: Sequence[str] | None = None,
                drop_empty: bool = False) -> DataFrame:
    """H-2 .. H-7: long (index, column, value) rows to a wide frame.

    * ``values``: the output columns, in order; absent categories give NULL.
    * ``row_domain``: keep only index values in this ordered domain and sort
      rows by it (rows not present in the data are not added).
    * ``drop_empty``: drop rows whose value columns are all NULL.

    The input is an aggregate (a few rows per index value), so the pivot's
    own aggregation is tiny.
    """
    # one row per (index, column) in the input; max() keeps that value deterministically
    wide = long.groupBy(index).pivot(columns, list(values)).agg(F.max(value))
    if row_domain is not None:
        pos = bracket_order(F.col(index), row_domain)
        wide = wide.filter(pos.isNotNull()).orderBy(pos)
    else:
        wide = wide.orderBy(index)
    if drop_empty:
        wide = wide.dropna(how="all", subset=[str(v) for v in values])
    return wide


def kpi_long(kpi: DataFrame, formatted: bool = True) -> DataFrame:
    """H-9 / C-14: the one-row KPI summary as (KPI, Value) rows.

    ``formatted`` gives text as in a report ('1,234', '11.2%', '4.4'); else
    numbers, with the two shares in percent.
    """
    total, rate = F.col("total_encounters"), F.col("readmission_rate")
    los, meds, risk = F.col("avg_los"), F.col("avg_medications"), F.col("high_risk_pct")
    if formatted:
        vals = [thousands(total), percent(rate), fixed(los), fixed(meds), percent(risk)]
    else:
        vals = [total.cast("double"), rate * 100.0, los, meds, risk * 100.0]
    cells = [F.struct(F.lit(i).alias("position"), F.lit(label).alias("KPI"), v.alias("Value"))
             for i, (label, v) in enumerate(zip(KPI_LABELS, vals))]
    return (kpi.select(F.array(*cells).alias("cells")).select(F.inline("cells"))
            .orderBy("position").drop("position"))
