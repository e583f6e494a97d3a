"""Pearson correlation matrix in one aggregate pass (G-32)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
                       digits: int | None = 3) -> DataFrame:
    """Long matrix (var_x, var_y, r) over pairwise-complete rows.

    ``r = covar_pop / (stddev_pop_x * stddev_pop_y)`` on the rows where both
    values are present (the pandas rule). A constant column gives NULL
    instead of a division-by-zero error under ANSI mode. ``-0.0`` after
    rounding is reported as ``0.0``. All pairs come from one aggregate.
    """
    if isinstance(columns, Mapping):
        exprs = dict(columns)
    else:
        exprs = {c: F.col(c) for c in columns}
    names = list(exprs)
    # One coefficient per unordered pair (the matrix is symmetric).
    pair_aggs = []
    for i, x in enumerate(names):
        for j in range(i, len(names)):
            y = names[j]
            both = exprs[x].isNotNull() & exprs[y].isNotNull()
            xv = F.when(both, exprs[x].cast("double"))
            yv = F.when(both, exprs[y].cast("double"))
            r = F.try_divide(F.covar_pop(xv, yv), F.stddev_pop(xv) * F.stddev_pop(yv))
            pair_aggs.append(r.alias(f"r_{i}_{j}"))
    cells = []
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            r = F.col(f"r_{min(i, j)}_{max(i, j)}")
            if digits is not None:
                r = F.round(r, digits)
            r = F.when(r == 0, F.lit(0.0)).otherwise(r)
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                                  F.lit(x).alias("var_x"), F.lit(y).alias("var_y"),
                                  r.alias("r")))
    return (df.agg(*pair_aggs).select(F.inline(F.array(*cells)))
            .orderBy("i", "j").drop("i", "j"))
