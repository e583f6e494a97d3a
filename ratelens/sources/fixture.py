"""Encounter-shaped view over the driver's TPC-H style tables.

The analysed project reads one CSV of hospital encounters that is not
available. ``encounters_raw`` derives a table with the same 28 columns (with
``?`` sentinels, repeated patients, sparse weight and rare medications) from
orders, customer, nation, region and lineitem. The same definition exists as
SQL text in ``ratelens.plans.oracles.ADAPTER_SQL`` for the DuckDB oracle; a
test checks that both give identical rows.

Plan shape (what scales): lineitem is aggregated per order (partial
aggregation map-side, one shuffle on ``l_orderkey``), orders are joined to that
aggregate on the same key, then joined to customer on ``custkey``. Only the
nation and region lookups are broadcast, each behind a row-count check;
customer and orders use shuffle joins unless AQE finds them small at runtime,
and AQE's skew-join split covers a hot customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import checked_broadcast, read_table

# --- Fixed values: adapter definition -----------------------------------------
REGION_TO_RACE = (("AFRICA", "AfricanAmerican"), ("AMERICA", "Caucasian"),
                  ("ASIA", "Asian"), ("EUROPE", "Hispanic"))
FEMALE_SEGMENTS = ("HOUSEHOLD", "FURNITURE")
LATE_ORDER_DATE = "1998-06-01 00:00:00"
# (column, modulus) for the "CASE id % m WHEN 1 Steady WHEN 2 Up WHEN 3 Down" rule.
CYCLIC_MEDICATIONS = (("repaglinide", 600), ("nateglinide", 13),
                      ("glimepiride", 17), ("glipizide", 7), ("glyburide", 9),
                      ("pioglitazone", 12), ("rosiglitazone", 14),
                      ("acarbose", 400))

RAW_COLUMNS = (
    "encounter_id", "patient_nbr", "race", "gender", "age", "weight",
    "time_in_hospital", "num_medications", "number_outpatient",
    "number_inpatient", "number_emergency", "number_diagnoses", "insulin",
    "metformin", "chlorpropamide", "repaglinide", "nateglinide", "glimepiride",
    "glipizide", "glyburide", "pioglitazone", "rosiglitazone", "acarbose",
    "admission_type_id", "discharge_disposition_id", "payer_code",
    "medical_specialty", "readmitted",
)


def _open_lines(flag: str) -> Column:
    hit = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == "O")
    return F.sum(F.when(hit, 1).otherwise(0)).cast("int")


def _bracket(lower: Column, width: int) -> Column:
    return F.concat(F.lit("["), (lower * width).cast("string"), F.lit("-"),
                    (lower * width + width).cast("string"), F.lit(")"))


def _cyclic_status(eid: Column, modulus: int) -> Column:
    r = eid % modulus
    return (F.when(r == 1, "Steady").when(r == 2, "Up").when(r == 3, "Down")
            .otherwise("No"))


FEW_CUSTOMERS = 100_000  # customers up to which they are broadcast to their orders

STORED = "stored:"  # marks the folder of a stored encounter table


def is_stored(source: str) -> bool:
    return source.startswith(STORED)


def encounters_raw(spark: SparkSession, source: str) -> DataFrame:
    """Raw encounter rows (strings with ``?`` kept), one per order.

    ``source`` is a folder of driver tables, from which the rows are derived,
    or the name that ``store_encounters`` returned, which is read as it is. A
    stored table whose write did not end (no ``_SUCCESS``) raises.
    """
    if not is_stored(source):
        return derive_encounters(spark, source)
    path = source[len(STORED):]
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        raise RuntimeError(f"{path} is not a completely written encounter table")
    return spark.read.parquet(path)


def store_encounters(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Derive the encounter rows once and write them to ``path`` (the load
    step); returns the name under which queries read the written table."""
    derive_encounters(spark, sf_dir).write.mode("overwrite").parquet(path)
    return STORED + path


def derive_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounter rows computed from orders, customer, nation, region, lineitem."""
    lines = (read_table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).cast("int").alias("n_lines"),
                  F.sum("l_quantity").alias("qty"),
                  _open_lines("R").alias("n_out"),
                  _open_lines("A").alias("n_inp"),
                  _open_lines("N").alias("n_emg")))
    geo = (read_table(spark, sf_dir, "nation")
           .join(checked_broadcast(read_table(spark, sf_dir, "region"), 10_000),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    cust = (read_table(spark, sf_dir, "customer")
            .select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(checked_broadcast(geo, 10_000),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_mktsegment", "r_name"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")

    b = (orders
         .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
         .join(checked_broadcast(cust, FEW_CUSTOMERS), F.col("o_custkey") == F.col("c_custkey"))
         .select(
             F.col("o_orderkey").alias("eid"),
             F.col("o_custkey").alias("pid"),
             "r_name", "c_mktsegment", "o_orderstatus",
             ((F.col("o_custkey") % 9).cast("int")
              + F.when(F.col("o_orderdate")
                       >= F.expr(f"TIMESTAMP_NTZ '{LATE_ORDER_DATE}'"), 1)
              .otherwise(0)).alias("decade"),
             F.floor(F.col("o_totalprice") / 50000).cast("int").alias("wband"),
             F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
             F.coalesce("qty", F.lit(0.0)).alias("qty"),
             F.coalesce("n_out", F.lit(0)).alias("n_out"),
             F.coalesce("n_inp", F.lit(0)).alias("n_inp"),
             F.coalesce("n_emg", F.lit(0)).alias("n_emg")))

    eid = F.col("eid")
    race = F.lit("?")
    for region, label in reversed(REGION_TO_RACE):
        race = F.when(F.col("r_name") == region, label).otherwise(race)
    cols = {
        "encounter_id": eid,
        "patient_nbr": F.col("pid"),
        "race": race,
        "gender": F.when(F.col("c_mktsegment").isin(*FEMALE_SEGMENTS), "Female")
                   .otherwise("Male"),
        "age": _bracket(F.col("decade"), 10),
        "weight": F.when(eid % 4 != 0, "?").when(F.col("wband") >= 8, ">200")
                   .otherwise(_bracket(F.col("wband"), 25)),
        "time_in_hospital": F.col("n_lines") + 1,
        "num_medications": F.floor(F.col("qty") / 10).cast("int") + 1,
        "number_outpatient": F.col("n_out"),
        "number_inpatient": F.col("n_inp"),
        "number_emergency": F.when(eid % 97 == 0, "?")
                             .otherwise(F.col("n_emg").cast("string")),
        "number_diagnoses": (1 + eid % 9).cast("int"),
        "insulin": F.when(eid % 8 < 4, "No").when(eid % 8 < 6, "Steady")
                    .when(eid % 8 == 6, "Up").otherwise("Down"),
        "metformin": F.when(eid % 10 < 8, "No").when(eid % 20 == 8, "Up")
                      .when(eid % 20 == 9, "Down").otherwise("Steady"),
        "chlorpropamide": F.when(eid % 1000 == 0, "Steady").otherwise("No"),
        "admission_type_id": (1 + eid % 5).cast("int"),
        "discharge_disposition_id": (1 + eid % 7).cast("int"),
        "payer_code": F.when(eid % 2 == 0, "?").otherwise("MC"),
        "medical_specialty": F.when(eid % 3 != 0, "?").otherwise("InternalMedicine"),
        "readmitted": F.when((F.col("o_orderstatus") == "P")
                             & ((eid % 5 == 0) | (F.col("n_lines") >= 6)), "<30")
                       .when(F.col("o_orderstatus") == "O", ">30").otherwise("NO"),
    }
    for name, modulus in CYCLIC_MEDICATIONS:
        cols[name] = _cyclic_status(eid, modulus)
    return b.select(*[cols[c].alias(c) for c in RAW_COLUMNS])
