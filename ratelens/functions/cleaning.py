"""Cleaning expressions: sentinel to null, numeric coercion, column checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MISSING_TOKENS, NUMERIC_COLUMNS


class MissingColumns(ValueError):
    """A step was given a frame without some of its input columns."""

    def __init__(self, step: str, absent: list[str], present: list[str]):
        super().__init__(f"{step}: no column {', '.join(absent)} among {', '.join(present)}")
        self.step, self.absent = step, absent


def check_columns(step: str, df: DataFrame, *names: str) -> DataFrame:
    """The frame itself, once its schema is known to hold ``names`` (C-9); no job runs."""
    present = set(df.columns)
    if not present.issuperset(names):
        raise MissingColumns(step, sorted(set(names) - present), df.columns)
    return df


def sentinel_to_null(col: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Whole-cell match of a missing-value token becomes NULL (C-1)."""
    if len(tokens) == 1:
        return F.nullif(col, F.lit(tokens[0]))
    return F.when(col.isin(*tokens), F.lit(None)).otherwise(col)


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


def numeric(col: Column, data_type: T.DataType | None = None) -> Column:
    """Count-like value as a number; text that is no number becomes NULL (C-2).

    Text becomes double, so '2.5' and values beyond the int range are kept.
    ``try_cast``, because under ANSI mode a plain cast of '?' would fail the
    job. A column that is already an integer type is returned as int without
    any conversion, so filters on it still reach the Parquet scan.
    """
    if isinstance(data_type, _INTEGRAL):
        return col if isinstance(data_type, T.IntegerType) else col.cast("int")
    d = col.try_cast("double") if isinstance(data_type, T.StringType) else \
        col.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def null_sentinels(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Replace missing tokens by NULL in every (or the given) string column."""
    targets = set(columns) if columns is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        sentinel_to_null(F.col(c), tokens).alias(c) if c in targets else F.col(c)
        for c in df.columns])


def coerce_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS,
                   rename: dict[str, str] | None = None) -> DataFrame:
    """Force the given columns to numbers, bad values to NULL (C-2, C-4).

    ``rename`` adds a converted copy under a new name, e.g.
    ``{"number_diagnoses": "num_diagnoses"}``.
    """
    check_columns("coerce_numeric", df, *columns, *(rename or {}))
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df.select(*[numeric(F.col(c), types[c]).alias(c) if c in columns else F.col(c)
                      for c in df.columns])
    if rename:
        out = out.withColumns({new: numeric(F.col(old), types[old])
                               for old, new in rename.items()})
    return out


def clean_encounters(raw: DataFrame, tokens: Sequence[str] = MISSING_TOKENS,
                     numeric_columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Sentinel to NULL and numeric coercion in a single projection (A-2)."""
    check_columns("clean_encounters", raw, *numeric_columns)
    types = {f.name: f.dataType for f in raw.schema.fields}
    exprs = []
    for c in raw.columns:
        e = F.col(c)
        if c in numeric_columns:
            e = numeric(e, types[c])  # a token such as '?' fails the parse -> NULL
        elif isinstance(types[c], T.StringType):
            e = sentinel_to_null(e, tokens)
        exprs.append(e.alias(c))
    return raw.select(*exprs)
