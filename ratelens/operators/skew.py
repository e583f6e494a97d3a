"""Joins on keys of which a few hold many rows.

A frequent-items sketch (one aggregate over the key column, a bounded number of
counters per task, nothing shuffled but sketches) names the keys whose rows exceed what
one task should hold. Only those are spread: their rows go to as many parts as their
number asks for, and only their few partner rows are copied to each part. Cold
keys are joined as they are, with no copies. The partners are never broadcast: they are few
per key, but as many as there are keys, and their size estimate comes from compressed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_ITEMS = 1000  # keys reported, at most: the broadcast list has no more rows
SKETCH_COUNTERS = 10_000  # counters of the sketch: counts are off by about rows / 10,000 at most
ROWS_PER_TASK = 1_000_000  # rows of one key that one task may hold


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """(``key``, salts) of the keys with more than ``rows_per_task`` rows, or None; ``salts`` follows
    the number of rows. At most ``SKETCH_ITEMS`` rows. NULL never joins, so it is no key."""
    found = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {SKETCH_ITEMS}, {SKETCH_COUNTERS})").alias("top"))
    hot = [(r["item"], -(-r["count"] // rows_per_task)) for r in found.first()["top"]
           if r["count"] > rows_per_task]
    if not hot:
        return None
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, __salts int"
    return df.sparkSession.createDataFrame(hot, schema)


def skew_join(rows: DataFrame, partners: DataFrame, key: str, spread_by: str,
              how: str = "inner", rows_per_task: int = ROWS_PER_TASK,
              hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to their few ``partners`` on ``key``; the rows of a hot key are spread
    by a hash of ``spread_by`` over its salts. ``how`` is inner or left."""
    if how not in ("inner", "left"):
        raise ValueError("skew_join spreads the left side: how must be inner or left")
    hot = hot_keys(rows, key, rows_per_task) if hot is None else hot
    if hot is None:
        return rows.join(partners.hint("merge"), key, how)
    hot = F.broadcast(hot)  # at most SKETCH_ITEMS rows
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    left = (rows.join(hot, key, "left")
            .withColumn("__salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")).drop("__salts"))
    right = (partners.join(hot, key, "left")
             .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts"))
    return left.join(right.hint("merge"), [key, "__salt"], how).drop("__salt")
