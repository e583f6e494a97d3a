"""Encounter sources and sinks (A-1 .. A-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MISSING_TOKENS, NUMERIC_COLUMNS
from ..functions.cleaning import check_columns, clean_encounters
from .fixture import RAW_COLUMNS, encounters_raw

_LONG = ("encounter_id", "patient_nbr")
_INT = ("number_diagnoses", "admission_type_id", "discharge_disposition_id")

# Raw schema: ids are long, three codes are int, everything else is read as
# text (the five count columns may hold '?', they are coerced after the read).
ENCOUNTER_SCHEMA = T.StructType([
    T.StructField(c, T.LongType() if c in _LONG else
                  T.IntegerType() if c in _INT else T.StringType(), True)
    for c in RAW_COLUMNS])


def read_encounters(spark: SparkSession, path: str,
                    schema: T.StructType = ENCOUNTER_SCHEMA) -> DataFrame:
    """A-1: headered CSV, columns taken by their header name in any order.

    The schema's columns come first, in its order and types (a value that
    does not parse is NULL); all other columns of the file follow as text.
    Only the header line is read to plan; columns that a query does not use are
    not parsed. A schema column that the file lacks raises ``MissingColumns``.
    """
    text = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = [f.name for f in schema.fields]
    check_columns(f"read_encounters({path})", text, *names)
    typed = [F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else
             F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    rest = [F.col(f"`{c}`") for c in text.columns if c not in set(names)]
    return text.select(*typed, *rest)


def read_encounters_checked(spark: SparkSession, path: str, schema: T.StructType = ENCOUNTER_SCHEMA,
                            tokens: Sequence[str] = MISSING_TOKENS,
                            numeric_columns: Sequence[str] = NUMERIC_COLUMNS,
                            id_col: str = "encounter_id") -> tuple[DataFrame, DataFrame]:
    """A-1 + C-9 with nothing lost in silence: (rows, rejected).

    ``rows`` is ``read_encounters`` without the lines that do not fit the header. ``rejected`` has
    one row per value or line that was not taken: file, line (the id of a value's line as
    text, the whole text of a line), column (NULL for a line), value and reason: ``line``
    (too few or too many fields), ``type`` (does not parse as the column's type) or ``number`` (a count
    that is neither a number nor a missing-value token). Both are lazy; one pass over the files each.
    """
    text = spark.read.option("header", True).csv(path)
    names = [f.name for f in schema.fields]
    check_columns(f"read_encounters_checked({path})", text, *names, id_col)
    kept = "_rejected_line"
    while kept in text.columns:
        kept += "_"
    strings = T.StructType([T.StructField(c, T.StringType()) for c in [*text.columns, kept]])
    lines = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
             .option("columnNameOfCorruptRecord", kept).schema(strings).csv(path))
    lines = lines.select(*[F.col(f"`{c}`") for c in lines.columns], F.col("_metadata.file_path").alias("__file"))
    # true of every line, but it needs every column: with pruned columns a line would be
    # measured against those that are read only
    whole = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in text.columns])) >= 0
    good = F.col(f"`{kept}`").isNull() & whole
    typed = [F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else
             F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    rest = [F.col(f"`{c}`") for c in text.columns if c not in set(names)]
    rows = lines.where(good).select(*typed, *rest)

    def reject(column: str, value: Column, reason: str, bad: Column) -> Column:
        return F.when(good & value.isNotNull() & ~value.isin(*tokens) & bad, F.struct(
            F.col(f"`{id_col}`").alias("line"), F.lit(column).alias("column"), value.alias("value"),
            F.lit(reason).alias("reason")))

    faults = [F.when(~good, F.struct(F.col(f"`{kept}`").alias("line"), F.lit(None).cast("string").alias("column"),
                                     F.lit(None).cast("string").alias("value"), F.lit("line").alias("reason")))]
    for f in schema.fields:
        value = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            faults.append(reject(f.name, value, "type", value.try_cast(f.dataType).isNull()))
        elif f.name in numeric_columns:
            number = value.try_cast("double")
            faults.append(reject(f.name, value, "number", number.isNull() | F.isnan(number)))
    rejected = (lines.select("__file", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f"))
                .select(F.col("__file").alias("file"), "f.line", "f.column", "f.value", "f.reason"))
    return rows, rejected


def load_encounters(spark: SparkSession, path: str | None = None, *,
                    sf_dir: str | None = None,
                    tokens: Sequence[str] = MISSING_TOKENS,
                    numeric_columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """A-2: read, turn missing tokens into NULL, force counts to numbers.

    Give a CSV ``path`` (A-1) or a driver ``sf_dir`` (adapter view).
    """
    if (path is None) == (sf_dir is None):
        raise ValueError("give exactly one of path or sf_dir")
    raw = read_encounters(spark, path) if path else encounters_raw(spark, sf_dir)
    return clean_encounters(raw, tokens, numeric_columns)


def save_table(df: DataFrame, name: str | None = None, *, path: str | None = None,
               bucket_by: str | None = None, buckets: int | None = None) -> None:
    """A-3: replace a table with the frame (no index column).

    With ``bucket_by`` the table is bucketed and sorted on that key, so later
    joins on it (encounter_id, patient_nbr) need no shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        if not name:
            raise ValueError("bucketing needs a catalog table name")
        writer = writer.bucketBy(buckets or 64, bucket_by).sortBy(bucket_by)
    if name:
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(name)
    elif path:
        writer.save(path)
    else:
        raise ValueError("give a table name or a path")


def read_saved(spark: SparkSession, name: str | None = None, *,
               path: str | None = None) -> DataFrame:
    """A-7: full-table read back; Catalyst prunes the columns a query uses."""
    return spark.table(name) if name else spark.read.parquet(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    """A-8: expose frames to ``spark.sql`` under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_encounter_tables(encounters: DataFrame, prefix: str = "") -> list[str]:
    """A-8: register the four tables of the SQL analysis as temp views.

    ``patients`` (all columns), ``patient_table`` (distinct patient, age,
    gender), ``encounters`` and ``utilization``, so existing SQL text can run
    through ``spark.sql``. Averages of ``CASE ... THEN 1.0`` become
    decimal(p, 5) in Spark; write ``1`` or ``1.0D`` for full precision.
    """
    from ..operators.tables import encounter_fact, patient_dim, utilization_fact
    views = {f"{prefix}patients": encounters,
             f"{prefix}patient_table": patient_dim(encounters),
             f"{prefix}encounters": encounter_fact(encounters),
             f"{prefix}utilization": utilization_fact(encounters)}
    register_views(views)
    return list(views)
