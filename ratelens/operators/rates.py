"""Event-rate cohort operators (section 2.6 of the survey).

``event_rate`` is one ``groupBy().agg()``: Spark aggregates partially inside
each scan task (hash aggregate in whole-stage codegen), shuffles only the
partial rows on the grouping keys and finishes there. Cohort keys have few
values, so a hot key costs nothing extra: it is combined map-side first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HIGH_MEDS_CUT, MAX_LOS_DAY, MEDS_HIGH, MEDS_LOW
from ..functions.cleaning import check_columns
from ..functions.flags import event_flag, high_risk, med_group

KeyLike = str | Column
RATE = "readmission_rate"


def _key_exprs(keys: Sequence[KeyLike]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def event_rate(df: DataFrame, keys: Sequence[KeyLike], event: Column | None = None, *,
               measures: Mapping[str, KeyLike] | Sequence[str] = (),
               scale: float = 1.0, digits: int | None = None,
               rate_name: str = RATE, count_name: str | None = None,
               min_n: int | None = None, more_than: int | None = None,
               order: str | Sequence[Column] | None = "key",
               limit: int | None = None, drop_null_keys: bool = False) -> DataFrame:
    """Rate of ``event`` (default: readmitted == '<30') per group of ``keys``.

    * ``measures``: extra means, ``{"avg_meds": "num_medications"}`` or a list
      of columns (named ``avg_<col>``), placed before the rate.
    * ``scale``/``digits``: percent scaling and rounding of the rate.
    * ``count_name``: include the group size under that name.
    * ``min_n``/``more_than``: HAVING count >= min_n / count > more_than.
    * ``order``: "key", "desc" or "asc" (by rate, keys as tie-break), a list
      of Columns, or None. ``limit`` keeps the first rows of that order.
    * ``drop_null_keys``: drop rows with a NULL key first (pandas groupby).
    """
    ev = event_flag() if event is None else event
    kexprs = _key_exprs(keys)
    if drop_null_keys:
        for k in kexprs:
            df = df.filter(k.isNotNull())
    if isinstance(measures, Mapping):
        mitems = list(measures.items())
    else:
        mitems = [(f"avg_{m}", m) for m in measures]
    rate = F.avg(ev)
    if scale != 1.0:
        rate = rate * F.lit(float(scale))
    if digits is not None:
        rate = F.round(rate, digits)
    n_col = count_name or "__n"
    aggs = [F.avg(F.col(m) if isinstance(m, str) else m).alias(name) for name, m in mitems]
    aggs += [rate.alias(rate_name), F.count(F.lit(1)).alias(n_col)]
    out = df.groupBy(*kexprs).agg(*aggs)
    if min_n is not None:
        out = out.filter(F.col(n_col) >= min_n)
    if more_than is not None:
        out = out.filter(F.col(n_col) > more_than)
    if count_name is None:
        out = out.drop(n_col)
    key_cols = [F.col(c) for c in out.columns[:len(kexprs)]]
    if order == "key":
        out = out.orderBy(*key_cols)
    elif order in ("desc", "asc"):
        r = F.col(rate_name).desc() if order == "desc" else F.col(rate_name).asc()
        out = out.orderBy(r, *key_cols)
    elif order is not None:
        out = out.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    return out


def patient_fanout_rate(enc: DataFrame, dim: DataFrame | None = None, key: str = "age", *,
                        measures: Mapping[str, str] = (), count_name: str | None = "patient_count",
                        rate_name: str = RATE, order: str | None = "desc",
                        limit: int | None = None,
                        dim_columns: Sequence[str] = ("patient_nbr", "age", "gender")) -> DataFrame:
    """G-11 / G-13: rate by a patient-table column through the fan-out join.

    Same numbers as ``encounters JOIN patient_table USING (patient_nbr)``
    grouped by ``patient_table.key``, where each encounter counts once per
    matching (patient, age, gender) row; the many-to-many join is never
    materialised.

    * ``dim`` given (a separate patient table): encounters are reduced to one
      row per patient (sums and counts), joined to the patient rows, and the
      sums are added per key.
    * ``dim`` None (the patient table is the distinct ``dim_columns`` of the
      same rows, as in the analysed project): one pass. Rows are grouped by
      (patient, age, gender), which gives the patient-table rows themselves;
      patient totals come from a window partitioned by patient over that
      aggregate (at most ages x genders rows per patient), then the totals are
      added per key. No join, and the source is read once.

    Either way a patient with a huge number of encounters is combined map-side
    into one row before any shuffle.
    """
    measures = dict(measures)
    check_columns("patient_fanout_rate", enc, "patient_nbr", "readmitted", *measures.values())
    sums = [F.sum(event_flag()).alias("__ev"), F.count(F.lit(1)).alias("__n")]
    for name, col in measures.items():
        sums += [F.sum(col).alias(f"__s_{name}"), F.count(col).alias(f"__c_{name}")]
    sum_cols = ["__ev", "__n"] + [x for name in measures for x in (f"__s_{name}", f"__c_{name}")]
    if dim is None:
        check_columns("patient_fanout_rate", enc, *dim_columns)
        # a NULL patient matches no patient row, as in the join
        per_row = enc.filter(F.col("patient_nbr").isNotNull()).groupBy(*dim_columns).agg(*sums)
        patient = Window.partitionBy("patient_nbr")
        joined = per_row.select(key, *[F.sum(c).over(patient).alias(c) for c in sum_cols])
    else:
        per_patient = enc.groupBy("patient_nbr").agg(*sums)
        joined = dim.select("patient_nbr", key).join(per_patient, "patient_nbr")
    aggs = [(F.sum(f"__s_{name}") / F.sum(f"__c_{name}")).alias(name) for name in measures]
    aggs.append((F.sum("__ev") / F.sum("__n")).alias(rate_name))
    if count_name:
        aggs.append(F.sum("__n").alias(count_name))
    out = joined.groupBy(key).agg(*aggs)
    if order == "desc":
        out = out.orderBy(F.col(rate_name).desc(), F.col(key))
    elif order == "key":
        out = out.orderBy(key)
    if limit is not None:
        out = out.limit(limit)
    return out


def kpi_summary(enc: DataFrame) -> DataFrame:
    """G-18: one-row KPI table (encounters, rate, avg LOS, avg meds, high-risk share)."""
    return enc.agg(
        F.count(F.lit(1)).alias("total_encounters"),
        F.avg(event_flag()).alias("readmission_rate"),
        F.avg("time_in_hospital").alias("avg_los"),
        F.avg("num_medications").alias("avg_medications"),
        F.avg(high_risk()).alias("high_risk_pct"))


def medication_gap(enc: DataFrame, cut: int = HIGH_MEDS_CUT,
                   max_los: int = MAX_LOS_DAY) -> DataFrame:
    """G-21: per LOS day, high-meds rate minus low-meds rate (percent).

    Both rates come from conditional means in one aggregate; no self-join.
    """
    grp = med_group(cut)
    ev = event_flag().cast("double")
    return (enc.filter(F.col("time_in_hospital") <= max_los)
            .groupBy(F.col("time_in_hospital").alias("los"))
            .agg((F.avg(F.when(grp == MEDS_HIGH, ev)) * 100.0).alias("high_meds_pct"),
                 (F.avg(F.when(grp == MEDS_LOW, ev)) * 100.0).alias("low_meds_pct"))
            .withColumn("gap", F.col("high_meds_pct") - F.col("low_meds_pct"))
            .orderBy("los"))


def rate_vs_overall(df: DataFrame, keys: Sequence[KeyLike], event: Column | None = None,
                    count_name: str = "patient_count") -> DataFrame:
    """G-33: group rate against the overall rate, with difference and lift.

    One pass: groups carry their event and row sums, and the overall rate is
    the ratio of their totals, taken with a window over the grouped rows (one
    row per cohort: keys are cohorts of few values, not ids). No second scan, no
    cross join. Without any event the lift is NULL.
    """
    ev = event_flag() if event is None else event
    grouped = (df.groupBy(*_key_exprs(keys))
               .agg(F.sum(ev).alias("__ev"), F.count(F.lit(1)).alias(count_name)))
    everything = Window.partitionBy()
    return (grouped
            .withColumn(RATE, F.col("__ev") / F.col(count_name))
            .withColumn("overall_rate", F.sum("__ev").over(everything)
                        / F.sum(count_name).over(everything))
            .withColumn("diff", F.col(RATE) - F.col("overall_rate"))
            .withColumn("lift", F.try_divide(F.col(RATE), F.col("overall_rate")))
            .drop("__ev"))

