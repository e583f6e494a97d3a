"""Named queries over the driver tables, one per inventory row.

Every query starts from the encounter view derived from the whole driver
tables (``sources.fixture``), so its work grows with them. Keys carry the
inventory id (``g07_...`` is G-7). ``MODEL_QUERIES`` train models and have no
SQL oracle; every other query has a DuckDB twin in ``plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (FEATURE_COLUMNS, LABEL_COLUMN, LOS_ORDER, MAX_LOS_DAY,
                         MED_GROUPS, MEDICATIONS, RISK_GROUPS, RISK_HIGH,
                         RISK_STANDARD, VISIT_COLUMNS_2, WEIGHT_ORDER, AGE_ORDER)
from ..functions.cleaning import clean_encounters, coerce_numeric
from ..functions.flags import (bracket_order, engineer_features,
                               event_flag, high_med_burden, high_meds,
                               high_risk, high_utilizer, long_stay,
                               los_category, med_group, risk_group,
                               sql_risk_score)
from ..functions.formatting import rate_band, sign_band
from ..ml import metrics as M
from ..ml import models as ML
from ..ml import trees as TR
from ..ml.group_split import deviation_bound, group_split
from ..ml.split import (approximate_split, part_rates, split_summary, stratified_folds,
                        stratified_split)
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import tables as T
from ..operators.correlation import correlation_matrix
from ..operators.medication import (dose_status_matrix, medication_impact,
                                    unpivot_medications)
from ..operators.rates import (event_rate, kpi_summary, medication_gap,
                               patient_fanout_rate, rate_vs_overall)
from ..operators.reshape import kpi_long, pivot_rate, pivot_table
from ..sources.fixture import encounters_raw
from ..session import materialize, new_scratch
from ..sources.published import publish
from ..sources.readers import read_encounters_checked, register_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MODEL_QUERIES: set[str] = set()


def query(name: str, model: bool = False):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if model:
            MODEL_QUERIES.add(name)
        return fn
    return register


# --- shared inputs (lazy plans; nothing runs until an action) ---------------
# The base frames are built once per (session, folder), as a user builds the
# cleaned frame once and queries it many times. DataFrames are immutable lazy
# plans, so sharing them is safe; every query is still planned and executed
# from the files when it runs.
_BASE: dict[tuple[int, str, str], DataFrame] = {}


def _memo(kind: str, spark: SparkSession, sf: str, build) -> DataFrame:
    key = (id(spark), sf, kind)
    df = _BASE.get(key)
    if df is None or df.sparkSession is not spark:
        df = _BASE[key] = build()
    return df


def reset_base_frames() -> None:
    """Forget the memoised base frames (e.g. after input files changed)."""
    _BASE.clear()


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return _memo("raw", spark, sf, lambda: encounters_raw(spark, sf))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return _memo("clean", spark, sf, lambda: clean_encounters(raw(spark, sf)))


def enc(spark: SparkSession, sf: str) -> DataFrame:
    return _memo("enc", spark, sf, lambda: engineer_features(clean(spark, sf)))


def written_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean rows read from the published copy of the encounter table.

    The SQL analysis writes its tables first and then joins them; the join
    queries do the same, so both sides of a join read the written columns
    instead of each recomputing the adapter from the driver tables. The copy
    is bucketed on the encounter id (one bucket per shuffle partition), so
    its 1:1 joins need no shuffle. It is written once per state of the
    inputs (``publish``): the next join query finds it.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return clean_encounters(publish(spark, "encounters", lambda: raw(spark, sf),
                                    bucket_by="encounter_id", buckets=buckets))


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return _memo("frame", spark, sf, lambda: ML.model_frame(enc(spark, sf)))


def rule_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic score over the whole model frame, for exact metric checks."""
    return frame(spark, sf).select(
        F.col("encounter_id").alias("id"), F.col(LABEL_COLUMN).alias("label"),
        ((F.col("time_in_hospital") + F.col("num_medications")) / 60.0).alias("score"))


LOS_DAYS = range(1, MAX_LOS_DAY + 1)

METRIC_DIGITS = 10  # sums of ratios are rounded in the query to remove summation-order noise

PCT = dict(scale=100.0, rate_name="readmission_pct")


# --- A: sources and tables ----------------------------------------------------

@query("a02_load_encounters")
def a02(spark, sf):
    return clean(spark, sf)


@query("a04_patient_dim")
def a04(spark, sf):
    return T.patient_dim(clean(spark, sf))


@query("a05_encounter_fact")
def a05(spark, sf):
    return T.encounter_fact(clean(spark, sf))


@query("a06_utilization_fact")
def a06(spark, sf):
    return T.utilization_fact(clean(spark, sf))


@query("a07_save_and_read_back")
def a07(spark, sf):
    """A-3 + A-7: the table written as a catalog table, read back and summed up."""
    return publish(spark, "clean_encounters", lambda: clean(spark, sf)).groupBy("race", "gender").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_medications").alias("medications"),
        F.max("encounter_id").alias("last_encounter"))


@query("a01_csv_with_quarantine")
def a01(spark, sf):
    """A-1 + C-9: the encounters written as CSV, columns in reverse order, some values
    spoilt; read by header name into rows and rejected values."""
    spoilt = raw(spark, sf).withColumns({
        "num_medications": F.when(F.col("encounter_id") % 50 == 0, "many").otherwise(F.col("num_medications").cast("string")),
        "number_inpatient": F.when(F.col("encounter_id") % 90 == 7, "NaN").otherwise(F.col("number_inpatient").cast("string")),
        "admission_type_id": F.when(F.col("encounter_id") % 70 == 1, "x1").otherwise(F.col("admission_type_id").cast("string"))})
    path = new_scratch(spark, "csv")
    spoilt.select(*reversed(spoilt.columns)).write.option("header", True).csv(path)
    rows, rejected = read_encounters_checked(spark, path)
    good = clean_encounters(rows).select(
        F.lit("row").alias("part"), F.col("encounter_id").cast("string").alias("line"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("reason"), F.col("num_medications").cast("long").alias("num_medications"),
        F.col("number_inpatient").cast("long").alias("number_inpatient"), "admission_type_id", "readmitted")
    bad = rejected.select(F.lit("rejected").alias("part"), "line", "column", "value", "reason",
                          *[F.lit(None).cast(t).alias(c) for c, t in good.dtypes[5:]])
    return good.unionByName(bad)


@query("a08_sql_readmission_breakdown")
def a08(spark, sf):
    register_views({"ratelens_patients": clean(spark, sf)})
    return spark.sql("SELECT readmitted, COUNT(*) AS count FROM ratelens_patients "
                     "GROUP BY readmitted")


# --- B: profiling ---------------------------------------------------------------

@query("b01_preview")
def b01(spark, sf):
    return P.preview(raw(spark, sf), 10)


@query("b02_shape")
def b02(spark, sf):
    return P.shape(raw(spark, sf))


@query("b03_describe_columns")
def b03(spark, sf):
    return P.describe_columns(clean(spark, sf))


@query("b04_null_profile")
def b04(spark, sf):
    return P.null_profile(clean(spark, sf), 15)


@query("b05_sentinel_profile")
def b05(spark, sf):
    return P.sentinel_profile(raw(spark, sf), "?", 15)


@query("b06_missing_percent")
def b06(spark, sf):
    return P.missing_percent(clean(spark, sf), 10)


@query("b07_readmitted_counts")
def b07(spark, sf):
    return P.value_counts(clean(spark, sf), "readmitted")


@query("b07_readmitted_counts_with_null")
def b07n(spark, sf):
    return P.value_counts(clean(spark, sf), "weight", drop_null=False)


@query("b08_total_count")
def b08(spark, sf):
    return P.total_count(clean(spark, sf))


@query("b09_avg_los")
def b09(spark, sf):
    return P.global_mean(clean(spark, sf), "time_in_hospital", "avg_los")


@query("b10_overall_rate")
def b10(spark, sf):
    return P.overall_rate(clean(spark, sf))


# --- C: cleaning, filters, formatting --------------------------------------------

@query("c03_drop_sparse_columns")
def c03(spark, sf):
    return Q.drop_columns(clean(spark, sf))


@query("c05_known_race")
def c05(spark, sf):
    return Q.known(clean(spark, sf), "race").select("encounter_id", "race")


@query("c06_insulin_prescribed")
def c06(spark, sf):
    return Q.prescribed(clean(spark, sf), "insulin").select("encounter_id", "insulin")


@query("c07_los_at_most_14")
def c07(spark, sf):
    return Q.at_most(clean(spark, sf), "time_in_hospital", MAX_LOS_DAY).select(
        "encounter_id", "time_in_hospital")


@query("c08_complete_case_report")
def c08(spark, sf):
    return Q.complete_case_report(enc(spark, sf), [*FEATURE_COLUMNS, LABEL_COLUMN])


@query("c10_age_los_pivot_filled")
def c10(spark, sf):
    return Q.fill_zero(pivot_rate(enc(spark, sf), "age", "time_in_hospital", LOS_DAYS))


@query("c13_weight_rate_band")
def c13(spark, sf):
    return g27(spark, sf).withColumn("band", rate_band(F.col("readmission_pct")))


@query("c13_medication_diff_direction")
def c13b(spark, sf):
    return g30(spark, sf).withColumn("direction", sign_band(F.col("diff")))


@query("c14_kpi_formatted")
def c14(spark, sf):
    return kpi_long(kpi_summary(enc(spark, sf)), formatted=True)


# --- D: flags, scores and listings ---------------------------------------------

@query("d10_engineered_features")
def d10(spark, sf):
    return enc(spark, sf).select(
        "encounter_id", "readmitted_flag", "long_stay", "high_med_burden",
        "high_utilizer", "age_risk", "risk_score", "risk_score_v2")


@query("d11_derived_columns")
def d11(spark, sf):
    return clean(spark, sf).select(
        "encounter_id",
        high_utilizer(columns=VISIT_COLUMNS_2).alias("high_utilizer_2col"),
        sql_risk_score().alias("sql_risk_score"),
        high_risk().alias("high_risk"), risk_group().alias("risk_group"),
        los_category().alias("los_category"), high_meds().alias("high_meds"),
        med_group().alias("med_group"),
        bracket_order("age", AGE_ORDER).alias("age_order"),
        bracket_order("weight", WEIGHT_ORDER).alias("weight_order"))


@query("d16_list_high_utilizer")
def d16(spark, sf):
    # encounters and utilization are projections of one row: no join needed
    return T.list_high_utilizer(clean(spark, sf))


@query("d17_list_long_stay")
def d17(spark, sf):
    return T.list_long_stay(T.encounter_fact(clean(spark, sf)))


@query("d18_list_high_med_burden")
def d18(spark, sf):
    return T.list_high_med_burden(T.utilization_fact(clean(spark, sf)))


def _three_way(spark, sf):
    c = written_clean(spark, sf)
    return T.encounter_view(T.encounter_fact(c), util=T.utilization_fact(c),
                            dim=T.patient_dim(c))


@query("d19_cohort_listing")
def d19(spark, sf):
    # E-3 on the wide row: only the patient-table join (the fan-out) is real
    c = written_clean(spark, sf)
    return T.cohort_listing(T.join_patient_dim(c.drop("age", "gender"), T.patient_dim(c)))


# --- E: joins ------------------------------------------------------------------

@query("e01_encounter_patient_join")
def e01(spark, sf):
    c = written_clean(spark, sf)
    return T.join_patient_dim(T.encounter_fact(c), T.patient_dim(c))


@query("e02_encounter_utilization_join")
def e02(spark, sf):
    c = written_clean(spark, sf)
    return T.join_on_encounter(T.encounter_fact(c), T.utilization_fact(c))


@query("e03_three_way_join")
def e03(spark, sf):
    return _three_way(spark, sf).select(
        "encounter_id", "patient_nbr", "age", "gender", "time_in_hospital",
        "num_medications", "readmitted")


@query("e04_encounter_patients_join")
def e04(spark, sf):
    c = written_clean(spark, sf)
    return T.join_on_encounter(T.encounter_fact(c), c).select(
        "encounter_id", "time_in_hospital", "readmitted", "race", "weight")


@query("e05_encounter_util_patients_join")
def e05(spark, sf):
    c = written_clean(spark, sf)
    return T.encounter_view(T.encounter_fact(c), util=T.utilization_fact(c),
                            patients=c).select(
        "encounter_id", "time_in_hospital", "num_medications", "race", "insulin",
        "weight", "readmitted")


# --- G: cohort rates ---------------------------------------------------------------

@query("g01_rate_by_age")
def g01(spark, sf):
    return event_rate(enc(spark, sf), ["age"], order="desc", drop_null_keys=True)


@query("g01_rate_by_age_ascending")
def g01b(spark, sf):
    return event_rate(enc(spark, sf), ["age"], order="asc", drop_null_keys=True)


@query("g02_rate_by_los")
def g02(spark, sf):
    return event_rate(enc(spark, sf), ["time_in_hospital"], drop_null_keys=True)


@query("g03_rate_by_num_diagnoses")
def g03(spark, sf):
    df = coerce_numeric(enc(spark, sf), [], rename={"number_diagnoses": "num_diagnoses"})
    return event_rate(df, ["num_diagnoses"], drop_null_keys=True)


@query("g04_rate_by_long_stay")
def g04(spark, sf):
    return event_rate(enc(spark, sf), ["long_stay"])


@query("g05_rate_by_high_med_burden")
def g05(spark, sf):
    return event_rate(enc(spark, sf), ["high_med_burden"])


@query("g06_rate_by_high_utilizer")
def g06(spark, sf):
    return event_rate(enc(spark, sf), ["high_utilizer"])


@query("g07_rate_by_risk_score")
def g07(spark, sf):
    return event_rate(enc(spark, sf), ["risk_score"], count_name="patient_count")


@query("g08_rate_by_risk_score_v2")
def g08(spark, sf):
    return event_rate(enc(spark, sf), ["risk_score_v2"])


@query("g09_sql_rate_by_age")
def g09(spark, sf):
    return event_rate(clean(spark, sf), ["age"], order="desc")


@query("g10_rate_count_by_los")
def g10(spark, sf):
    return event_rate(clean(spark, sf), ["time_in_hospital"], count_name="patient_count")


@query("g11_rate_by_age_patient_join")
def g11(spark, sf):
    # the patient table is the distinct (patient, age, gender) of the same rows
    return patient_fanout_rate(clean(spark, sf), None, "age")


@query("g12_meds_rate_by_los")
def g12(spark, sf):
    return event_rate(clean(spark, sf), ["time_in_hospital"],
                      measures={"avg_meds": "num_medications"})


@query("g13_age_profile_top10")
def g13(spark, sf):
    return patient_fanout_rate(
        clean(spark, sf), None, "age",
        measures={"avg_meds": "num_medications", "avg_los": "time_in_hospital"},
        count_name="count", order="desc", limit=10)


@query("g14_high_utilizer_cohort")
def g14(spark, sf):
    return event_rate(clean(spark, sf),
                      [high_utilizer(columns=VISIT_COLUMNS_2).alias("high_utilizer")],
                      count_name="count")


@query("g15_long_stay_cohort")
def g15(spark, sf):
    return event_rate(clean(spark, sf), [long_stay().alias("long_stay")], count_name="count")


@query("g16_med_burden_cohort")
def g16(spark, sf):
    return event_rate(clean(spark, sf), [high_med_burden().alias("high_med_burden")],
                      count_name="count")


@query("g17_sql_risk_score_cohort")
def g17(spark, sf):
    return event_rate(clean(spark, sf), [sql_risk_score().alias("risk_score")],
                      count_name="count")


@query("g18_kpi_summary")
def g18(spark, sf):
    return kpi_summary(clean(spark, sf))


def _groups(*names):
    exprs = {"los_category": los_category(), "med_group": med_group(),
             "risk_group": risk_group()}
    return [exprs[n].alias(n) if n in exprs else F.col(n) for n in names]


@query("g19_los_meds_risk")
def g19(spark, sf, order="desc"):
    return event_rate(clean(spark, sf), _groups("los_category", "med_group", "risk_group"),
                      digits=1, count_name="patient_count", order=order, **PCT)


@query("g20_los_day_meds")
def g20(spark, sf):
    df = Q.at_most(clean(spark, sf), "time_in_hospital", MAX_LOS_DAY)
    return event_rate(df, [F.col("time_in_hospital").alias("los"), med_group().alias("med_group")],
                      **PCT)


@query("g21_medication_gap")
def g21(spark, sf):
    return medication_gap(clean(spark, sf))


@query("g22_rate_by_race")
def g22(spark, sf):
    return event_rate(Q.known(clean(spark, sf), "race"), ["race"], digits=2,
                      count_name="patient_count", order="desc", **PCT)


@query("g23_race_risk")
def g23(spark, sf, order="key"):
    return event_rate(Q.known(clean(spark, sf), "race"), _groups("race", "risk_group"),
                      digits=1, count_name="count", order=order, **PCT)


@query("g24_race_los")
def g24(spark, sf, order="key"):
    return event_rate(Q.known(clean(spark, sf), "race"), _groups("race", "los_category"),
                      digits=1, order=order, **PCT)


@query("g25_race_meds_risk")
def g25(spark, sf):
    return event_rate(Q.known(clean(spark, sf), "race"),
                      _groups("race", "med_group", "risk_group"), digits=1,
                      count_name="patient_count", min_n=20, order="desc", **PCT)


@query("g26_insulin_dose_risk")
def g26(spark, sf, order="key"):
    return event_rate(Q.prescribed(clean(spark, sf), "insulin"),
                      [F.col("insulin").alias("dose_status"), risk_group().alias("risk_group")],
                      digits=1, count_name="count", order=order, **PCT)


@query("g27_weight_rate")
def g27(spark, sf):
    rates = event_rate(Q.known(clean(spark, sf), "weight"), ["weight"], digits=1,
                       count_name="count", min_n=20, order=None, **PCT)
    pos = bracket_order("weight", WEIGHT_ORDER)
    return rates.filter(pos.isNotNull()).orderBy(pos)


@query("g28_weight_los")
def g28(spark, sf, order="key"):
    return event_rate(Q.known(clean(spark, sf), "weight"), _groups("weight", "los_category"),
                      digits=1, count_name="count", min_n=15, order=order, **PCT)


@query("g29_weight_meds")
def g29(spark, sf, order="key"):
    return event_rate(Q.known(clean(spark, sf), "weight"), _groups("weight", "med_group"),
                      digits=1, count_name="count", min_n=15, order=order, **PCT)


@query("g30_medication_impact")
def g30(spark, sf):
    return medication_impact(clean(spark, sf))


@query("g31_dose_status_matrix")
def g31(spark, sf):
    return dose_status_matrix(clean(spark, sf))


@query("g32_correlation_matrix")
def g32(spark, sf):
    return correlation_matrix(clean(spark, sf), {
        "time_in_hospital": F.col("time_in_hospital"),
        "num_medications": F.col("num_medications"),
        "high_meds": high_meds(), "high_risk": high_risk(),
        "readmitted": event_flag()})


@query("g33_lift_by_risk_score")
def g33(spark, sf):
    return rate_vs_overall(enc(spark, sf), ["risk_score"])


@query("g33_lift_by_high_utilizer")
def g33b(spark, sf):
    return rate_vs_overall(enc(spark, sf), ["high_utilizer"])


@query("g34_rate_by_admission_type")
def g34(spark, sf):
    return event_rate(clean(spark, sf), ["admission_type_id"], count_name="patient_count")


@query("g34_rate_by_discharge_disposition")
def g34b(spark, sf):
    return event_rate(clean(spark, sf), ["discharge_disposition_id"],
                      count_name="patient_count")


# --- H: reshape --------------------------------------------------------------------

@query("h01_age_los_pivot")
def h01(spark, sf):
    return pivot_rate(enc(spark, sf), "age", "time_in_hospital", LOS_DAYS)


def _risk_pivot(spark, sf, label):
    g = g19(spark, sf, order=None).filter(F.col("risk_group") == label)
    return pivot_table(g, "los_category", "med_group", "readmission_pct", MED_GROUPS,
                       row_domain=LOS_ORDER)


@query("h02_los_meds_pivot_high_risk")
def h02(spark, sf):
    return _risk_pivot(spark, sf, RISK_HIGH)


@query("h02_los_meds_pivot_standard_risk")
def h02b(spark, sf):
    return _risk_pivot(spark, sf, RISK_STANDARD)


@query("h03_race_risk_pivot")
def h03(spark, sf):
    return pivot_table(g23(spark, sf, order=None), "race", "risk_group", "readmission_pct", RISK_GROUPS)


@query("h04_race_los_pivot")
def h04(spark, sf):
    return pivot_table(g24(spark, sf, order=None), "race", "los_category", "readmission_pct", LOS_ORDER)


@query("h05_insulin_risk_pivot")
def h05(spark, sf):
    return pivot_table(g26(spark, sf, order=None), "dose_status", "risk_group", "readmission_pct",
                       RISK_GROUPS)


@query("h06_weight_los_pivot")
def h06(spark, sf):
    return pivot_table(g28(spark, sf, order=None), "weight", "los_category", "readmission_pct",
                       LOS_ORDER, row_domain=WEIGHT_ORDER)


@query("h07_weight_meds_pivot")
def h07(spark, sf):
    return pivot_table(g29(spark, sf, order=None), "weight", "med_group", "readmission_pct",
                       MED_GROUPS, row_domain=WEIGHT_ORDER, drop_empty=True)


@query("h08_unpivot_medications")
def h08(spark, sf):
    return unpivot_medications(clean(spark, sf), ["encounter_id"], MEDICATIONS)


@query("h09_kpi_long")
def h09(spark, sf):
    return kpi_long(kpi_summary(clean(spark, sf)), formatted=False)


# --- J: modelling and evaluation ----------------------------------------------------

@query("j01_model_frame")
def j01(spark, sf):
    return frame(spark, sf)


@query("j02_split_summary")
def j02(spark, sf):
    return split_summary(_split(spark, sf), LABEL_COLUMN)


def _ids_and_labels(spark, sf):
    """The two columns a split reads, written once (it reads its input three times)."""
    return materialize(frame(spark, sf).select("encounter_id", LABEL_COLUMN))


def _split(spark, sf):
    return stratified_split(_ids_and_labels(spark, sf), LABEL_COLUMN, "encounter_id")


@query("j02_split_rates")
def j02r(spark, sf):
    return part_rates(_split(spark, sf), LABEL_COLUMN)


@query("j02_split_membership")
def j02m(spark, sf):
    return _split(spark, sf).select("encounter_id", "is_test")


@query("j02_group_split_quotas")
def j02g(spark, sf):
    """Patients whole, classes at their quotas: rows and test rows per class, whether they are within
    the stated bound of a fifth, and patients in both parts."""
    rows = materialize(frame(spark, sf).join(clean(spark, sf).select("encounter_id", "patient_nbr"), "encounter_id")
                       .select("encounter_id", "patient_nbr", LABEL_COLUMN))
    parts = materialize(group_split(rows, LABEL_COLUMN, "patient_nbr"))
    both = (parts.groupBy("patient_nbr").agg(F.countDistinct("is_test").alias("parts"))
            .agg(F.count_if(F.col("parts") > 1).alias("patients_in_both")))
    per_class = parts.groupBy(LABEL_COLUMN).agg(F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("test"))
    bound = deviation_bound(rows, LABEL_COLUMN, "patient_nbr")
    return (per_class.join(F.broadcast(bound), LABEL_COLUMN)  # one row per class
            .withColumn("one", F.lit(1)).join(F.broadcast(both.withColumn("one", F.lit(1))), "one")
            .select(LABEL_COLUMN, "n", "patients_in_both",
                    (F.abs(F.col("test") - 0.2 * F.col("n")) <= F.col("bound")).alias("within_bound")))


@query("j02_approximate_split")
def j02a(spark, sf):
    parts = approximate_split(frame(spark, sf), LABEL_COLUMN, "encounter_id", {0: 0.2, 1: 0.5})
    share = F.when(F.col(LABEL_COLUMN) == 1, 0.5).otherwise(0.2)
    return (parts.groupBy(LABEL_COLUMN).agg(F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("n_test"))
            .withColumn("within_bound", F.abs(F.col("n_test") - F.col("n") * share)
                        <= 5 * F.sqrt(F.col("n") * share * (1 - share))))


@query("j03_class_weights")
def j03(spark, sf):
    return ML.class_weight_table(frame(spark, sf))


@query("j08_roc_auc")
def j08(spark, sf):
    return M.roc_auc(rule_scored(spark, sf))


@query("j09_average_precision")
def j09(spark, sf):
    return M.average_precision(rule_scored(spark, sf)).select(
        F.round("average_precision", METRIC_DIGITS).alias("average_precision"))


@query("j10_roc_curve")
def j10(spark, sf):
    return M.roc_curve(rule_scored(spark, sf))


@query("j11_pr_curve")
def j11(spark, sf):
    return M.pr_curve(rule_scored(spark, sf))


@query("j16_confusion_matrix")
def j16(spark, sf):
    return M.confusion(rule_scored(spark, sf))


@query("j17_threshold_sweep")
def j17(spark, sf):
    return M.threshold_sweep(rule_scored(spark, sf))


@query("j18_classification_report")
def j18(spark, sf):
    return M.classification_report(rule_scored(spark, sf))


@query("j19_fold_summary")
def j19f(spark, sf):
    return split_summary(stratified_folds(_ids_and_labels(spark, sf), LABEL_COLUMN,
                                          "encounter_id"), LABEL_COLUMN, part="fold")


@query("j04_feature_moments")
def j04(spark, sf):
    return ML.feature_moments(frame(spark, sf)).select(
        "feature", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


@query("j12_rule_comparison")
def j12r(spark, sf):
    scores = {"Random Forest": F.col("time_in_hospital") + F.col("num_medications"),
              "Logistic Regression": F.col("number_inpatient") + F.col("number_outpatient")}
    found = ML.with_best_flag(ML.compare_models({
        name: frame(spark, sf).select(F.col("encounter_id").alias("id"),
                                      F.col(LABEL_COLUMN).alias("label"),
                                      (score / 60.0).alias("score"))
        for name, score in scores.items()}))
    return found.select("model", F.round("roc_auc", METRIC_DIGITS).alias("roc_auc"),
                        F.round("average_precision", METRIC_DIGITS).alias("average_precision"),
                        "best")


@query("j20_fold_table_summary")
def j20t(spark, sf):
    by_fold = frame(spark, sf).groupBy(
        F.when(F.col("long_stay") == 1, "long").otherwise("short").alias("model"),
        (F.col("encounter_id") % 5).cast("int").alias("fold")).agg(
            F.avg(LABEL_COLUMN).alias("roc_auc"))
    found = M.cv_summary(by_fold)
    return found.select("model", F.round("mean", METRIC_DIGITS).alias("mean"),
                        F.round("std", METRIC_DIGITS).alias("std"),
                        F.size("scores").alias("folds"))


def _two_rules(spark, sf):
    """Two rule scores over the whole model frame, dealt into five folds by the encounter id."""
    f = frame(spark, sf)
    one = f.select((F.col("encounter_id") % 5).cast("int").alias("fold"), F.col(LABEL_COLUMN).alias("label"),
                   F.explode(F.array(
                       F.struct(F.lit("stay and medications").alias("model"),
                                ((F.col("time_in_hospital") + F.col("num_medications")) / 60.0).alias("score")),
                       F.struct(F.lit("visits").alias("model"),
                                ((F.col("number_inpatient") + F.col("number_outpatient")) / 60.0).alias("score")))
                   ).alias("rule"))
    return one.select("rule.model", "fold", "label", "rule.score")


@query("j08_metrics_by_model_and_fold")
def j08k(spark, sf):
    found = M.ranking_metrics_by_key(_two_rules(spark, sf), ["model", "fold"])
    return found.select("model", "fold", *[F.round(c, METRIC_DIGITS).alias(c) for c in
                                           ("roc_auc", "average_precision", "positive_rate")])


@query("j10_curves_by_model_and_fold")
def j10k(spark, sf):
    return M.curves_by_key(_two_rules(spark, sf), ["model", "fold"])


@query("j19_fold_training_sets")
def j19c(spark, sf):
    """Class counts and feature moments of every fold's training set, from the fold cube."""
    folds = frame(spark, sf).withColumn("fold", (F.col("encounter_id") % 5).cast("int"))
    found = ML.cube_statistics(ML.fold_cube(folds))
    cells = [F.struct(F.lit(f).alias("fold"), F.lit(c).alias("feature"), F.lit(counts.get(0, 0)).alias("negatives"),
                      F.lit(counts.get(1, 0)).alias("positives"), F.lit(m).alias("mean"), F.lit(s).alias("sd"))
             for f, (counts, moments) in found.items() for c, (m, s) in moments.items()]
    out = spark.range(1).select(F.inline(F.array(*cells)))
    return out.select("fold", "feature", F.col("negatives").cast("long").alias("negatives"),
                      F.col("positives").cast("long").alias("positives"),
                      F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


# A fixed forest, as a node table: tree, node, feature, cut, yes (feature <= cut), no.
FIXED_FOREST = (
    (0, 0, "num_medications", 13.5, 1, 2), (0, 1, "time_in_hospital", 3.5, 3, 4),
    (0, 2, "number_inpatient", 1.5, 5, 6), (0, 3, None, None, None, None), (0, 4, None, None, None, None),
    (0, 5, "age_risk", 0.5, 7, 8), (0, 6, None, None, None, None), (0, 7, None, None, None, None),
    (0, 8, None, None, None, None),
    (1, 0, "long_stay", 0.5, 1, 2), (1, 1, None, None, None, None), (1, 2, "number_emergency", 0.5, 3, 4),
    (1, 3, None, None, None, None), (1, 4, None, None, None, None),
    (2, 0, "number_outpatient", 1.5, 1, 2), (2, 1, "num_medications", 9.5, 3, 4), (2, 2, None, None, None, None),
    (2, 3, None, None, None, None), (2, 4, "time_in_hospital", 5.5, 5, 6), (2, 5, None, None, None, None),
    (2, 6, None, None, None, None))


def _fixed_forest(spark, sf):
    """The fixed questions with weights measured on the whole model frame."""
    cells = [F.struct(F.lit(t).alias("tree"), F.lit(n).alias("node"), F.lit(f).cast("string").alias("feature"),
                      F.lit(c).cast("double").alias("cut"), F.lit(y).cast("int").alias("yes"),
                      F.lit(no).cast("int").alias("no"), *[F.lit(None).cast("double").alias(x) for x in ("gain", "w0", "w1")])
             for t, n, f, c, y, no in FIXED_FOREST]
    nodes = spark.range(1).select(F.inline(F.array(*cells)))
    rows = frame(spark, sf)
    return TR.refit_nodes(TR.forest_from_nodes(nodes), ML.balanced_weights(rows))


@query("j06_forest_node_table")
def j06n(spark, sf):
    return _fixed_forest(spark, sf).nodes.select(
        "tree", "node", "feature", "cut", "yes", "no", F.round("gain", METRIC_DIGITS).alias("gain"),
        F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"))


@query("j07_forest_scores_by_descent")
def j07n(spark, sf):
    found = TR.score_nodes(frame(spark, sf), _fixed_forest(spark, sf))
    return found.select("id", "label", F.round("score", METRIC_DIGITS).alias("score"))


@query("j14_importances_of_node_table")
def j14n(spark, sf):
    return TR.node_importances(_fixed_forest(spark, sf)).select(
        "feature", F.round("importance", METRIC_DIGITS).alias("importance"))


def _train_test(spark, sf):
    """The model frame with its split, written once in a fixed layout."""
    rows = frame(spark, sf).join(_split(spark, sf).select("encounter_id", "is_test"),
                                 "encounter_id")
    split = materialize(ML.fixed_layout(rows, "encounter_id"))
    return split.filter("is_test = 0"), split.filter("is_test = 1")


@query("j05_lr_coefficients", model=True)
def j05(spark, sf):
    train, _ = _train_test(spark, sf)
    return ML.coefficients(ML.fit_logistic(train))


@query("j05_logistic_optimality")
def j05g(spark, sf):
    """The gradient at the fitted coefficients, on the training part: 0 at 6 digits."""
    train, _ = _train_test(spark, sf)
    found = ML.logistic_gradient(ML.fit_logistic(train), train)
    return found.select("feature", (F.round("gradient", 6) + F.lit(0.0)).alias("gradient"))


@query("j14_rf_top3_importances", model=True)
def j14(spark, sf):
    train, _ = _train_test(spark, sf)
    return ML.importances(ML.fit_forest(train), top=3)


@query("j07_lr_test_scores", model=True)
def j07(spark, sf):
    train, test = _train_test(spark, sf)
    return ML.score(ML.fit_logistic(train), test)


@query("j12_model_comparison", model=True)
def j12(spark, sf):
    train, test = _train_test(spark, sf)
    return ML.with_best_flag(ML.compare_models({
        "Logistic Regression": ML.score(ML.fit_logistic(train), test),
        "Random Forest": ML.score(ML.fit_forest(train), test)}))


@query("j20_cv_summary", model=True)
def j20(spark, sf):
    return M.cv_summary(ML.cross_validate(frame(spark, sf)))


@query("j18_best_model_report", model=True)
def j18b(spark, sf):
    train, test = _train_test(spark, sf)
    return ML.evaluate_best(train, test)["report"]
