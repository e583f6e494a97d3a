"""Inputs at the edges: absent classes, NULL and NaN, unsorted grids, hot keys, late days."""

import pytest
from pyspark.sql import functions as F

from ratelens.ml import metrics as M
from ratelens.ml import models as ML
from ratelens.operators.rates import patient_fanout_rate, rate_vs_overall
from ratelens.operators.reshape import pivot_rate
from ratelens.operators.tables import join_patient_dim, patient_dim

SF_LARGE = "/root/testdata/sf0.1"


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, score double")


def test_metrics_with_one_class_are_null(spark):
    df = scored(spark, [(1, 0, 0.2), (2, 0, 0.7)])
    r = M.ranking_metrics(df).first()
    assert r.roc_auc is None and r.average_precision is None and r.positive_rate == 0
    assert {p.tpr for p in M.roc_curve(df).collect() if p.threshold is not None} == {None}


def test_nan_scores_are_left_out(spark):
    df = scored(spark, [(1, 1, float("nan")), (2, 1, 0.1), (3, 0, 0.9)])
    assert M.roc_auc(df).first()[0] == 0.0


def test_curves_hold_their_end_points(spark):
    df = scored(spark, [(1, 1, 0.9), (2, 0, 0.1)])
    assert tuple(M.roc_curve(df).first()) == (None, 0.0, 0.0)
    assert tuple(M.pr_curve(df).first()) == (None, 1.0, 0.0)
    assert M.roc_curve(df).count() == 3


def test_sweep_grid_in_any_order(spark):
    df = scored(spark, [(1, 1, 0.8), (2, 1, 0.6), (3, 0, 0.55)])
    a = M.threshold_sweep(df, [0.75, 0.5, 0.75]).collect()
    assert a == M.threshold_sweep(df, [0.5, 0.75]).collect()
    assert [(r.threshold, r.tp, r.fp) for r in a] == [(0.5, 2, 1), (0.75, 1, 0)]


def test_lift_without_events_is_null(spark):
    df = spark.createDataFrame([("a", "NO"), ("b", "NO")], "k string, readmitted string")
    rows = rate_vs_overall(df, ["k"]).collect()
    assert [(r.readmission_rate, r["lift"]) for r in rows] == [(0.0, None)] * 2


def test_null_patient_in_both_fanout_forms(spark):
    rows = [(None, "[0-10)", "F", "<30"), (None, "[0-10)", "F", "NO"), (1, "[0-10)", "F", "NO")]
    enc = spark.createDataFrame(rows, "patient_nbr long, age string, gender string, readmitted string")
    one = patient_fanout_rate(enc).collect()
    assert one == patient_fanout_rate(enc, patient_dim(enc)).collect()
    assert [(r.age, r.patient_count) for r in one] == [("[0-10)", 1)]


def test_hot_patient_rows_spread_over_tasks(spark):
    """Row-level join: the rows of one patient land in several partitions."""
    enc = spark.range(4000).select(
        F.col("id").alias("encounter_id"), F.lit(5).cast("long").alias("patient_nbr"),
        F.lit(3).alias("time_in_hospital"), F.lit("NO").alias("readmitted"))
    dim = spark.createDataFrame([(5, "[0-10)", "F"), (5, "[10-20)", "F"), (6, "[0-10)", "M")],
                                "patient_nbr long, age string, gender string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_patient_dim(enc, dim, rows_per_task=500)
        parts = joined.groupBy(F.spark_partition_id()).count().collect()
        assert joined.count() == 8000 == join_patient_dim(enc, dim).count()
        assert len(parts) > 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_late_days_are_pooled_not_lost(spark):
    """sf0.1 has stays beyond 14 days; every row is in one cell of the pivot."""
    from ratelens.plans.catalog import LOS_DAYS, enc
    df = enc(spark, SF_LARGE).select("age", "time_in_hospital", "readmitted_flag", "readmitted")
    cells = pivot_rate(df, "age", "time_in_hospital", LOS_DAYS).collect()
    late = {r.age: r.m for r in df.filter("time_in_hospital > 14").groupBy("age")
            .agg(F.avg("readmitted_flag").alias("m")).collect()}
    assert late and {r.age: r.other for r in cells if r.other is not None} == late
    counts = df.groupBy("age", F.when(F.col("time_in_hospital") <= 14, F.col("time_in_hospital"))
                        .alias("day")).count().collect()
    assert sum(r["count"] for r in counts) == df.count()
    assert sum(v is not None for r in cells for v in r[1:]) == len(counts)


@pytest.fixture(scope="module")
def train(spark):
    from conftest import SF_SMALL
    from ratelens.plans.catalog import frame
    return frame(spark, SF_SMALL).cache()


def test_grouped_logistic_equals_ungrouped(train):
    a = ML.fit_logistic(train).stages[-1]
    b = ML.fit_logistic(train, group=False).stages[-1]
    assert abs(a.coefficients.toArray() - b.coefficients.toArray()).max() < 1e-6
    assert abs(a.intercept - b.intercept) < 1e-6


def test_logistic_gradient_is_near_zero(train):
    """J-5: at the fitted point the penalised, balanced gradient vanishes."""
    import numpy as np
    model = ML.fit_logistic(train)
    pdf = train.toPandas()
    names = list(ML.FEATURE_COLUMNS)
    x = pdf[names].to_numpy(float)
    sd = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    y = pdf["readmitted_flag"].to_numpy(float)
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    lr = model.stages[-1]
    p = 1 / (1 + np.exp(-(x @ lr.coefficients.toArray() + lr.intercept)))
    grad = x.T @ (w * (p - y)) / n + lr.coefficients.toArray() / n
    assert abs(grad).max() < 1e-3 and abs((w * (p - y)).sum() / n) < 1e-3


def test_forest_depth_bins_and_layout(spark, train):
    rf = ML.fit_forest(train, trees=2).stages[-1]
    most = max(train.agg(*[F.count_distinct(c) for c in ML.FEATURE_COLUMNS]).first())
    assert rf.getOrDefault("maxDepth") == 30 and rf.getOrDefault("maxBins") > most
    fits = [ML.fit_forest(ML.fixed_layout(train.repartition(n), partitions=4), trees=3, max_depth=5)
            .stages[-1].featureImportances.toArray().tolist() for n in (2, 7)]
    assert fits[0] == fits[1]


def test_class_counts_refuse_an_id(spark):
    with pytest.raises(ValueError, match="classes"):
        ML.class_counts(spark.range(2000).withColumnRenamed("id", "y"), "y")
