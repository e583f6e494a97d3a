"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, new_scratch


def text_or_empty(col: str = "text") -> Column:
    """The whole text, with null read as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def written(df: DataFrame, compression: str = "zstd", **options) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared checkpoint folder; the frame that reads it, and its path."""
    spark = df.sparkSession
    path = new_scratch(spark, "llm")
    df.write.mode("overwrite").options(**options).option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: For tables of large rows: row groups of about 8 MB, so that a reader, which takes
#: up to thousands of rows of a row group at once, holds no more.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1,
              "parquet.page.size.row.check.max": 4}


def drop(df: DataFrame, *paths: str) -> None:
    """Delete intermediate tables that no live plan reads any more."""
    for path in paths:
        delete_path(df.sparkSession, path)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: the empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def free_name(taken, base: str) -> str:
    """``base``, or ``base_1``, ... : a column name that ``taken`` does not hold."""
    used = {c.lower() for c in taken}
    name, i = base, 0
    while name.lower() in used:
        i += 1
        name = f"{base}_{i}"
    return name


_RESIDENT: dict = {}


def release() -> None:
    """Drop what the worker keeps of an earlier stage: for tasks that need the memory and keep nothing."""
    _RESIDENT.clear()


def resident(key, make):
    """What a Python worker keeps between tasks: the value of ``key``, made on
    first use. Only the last key's value is kept, so the tables of an earlier
    stage do not stay in memory beside those of a later one."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]
