"""Whole-group splits with quotas, one-pass split, fold cube, metrics by key, optimality."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.constants import FEATURE_COLUMNS
from ratelens.ml import metrics as M
from ratelens.ml import models as ML
from ratelens.ml.group_split import assign_groups, deviation_bound, group_folds, group_split, round_types
from ratelens.ml.split import approximate_split
from ratelens.plans.catalog import frame
from conftest import SF_SMALL


def test_rounding_moves_each_class_by_few_groups():
    for seed in range(30):
        rnd = random.Random(seed)
        c = rnd.randint(1, 4)
        vectors = [[rnd.randint(0, 50) for _ in range(c)] for _ in range(rnd.randint(0, 60))]
        x = [rnd.choice([0.0, rnd.random(), 0.2]) for _ in vectors]
        up = round_types(vectors, x)
        assert all(u == 0 for u, f in zip(up, x) if f == 0) and set(up) <= {0, 1}
        for k in range(c):
            off = sum(v[k] * (u - f) for v, u, f in zip(vectors, up, x))
            assert abs(off) <= c * max((v[k] for v in vectors), default=0) + 1e-6


@pytest.fixture(scope="module")
def patients(spark):
    """One patient holds half of all rows; others 1 to 12; NULL patients and labels exist."""
    rnd = random.Random(5)
    rows, p = [], 1
    while len(rows) < 6000:
        rate = rnd.choice([0.0, 0.1, 0.5, 1.0])
        rows += [(p, int(rnd.random() < rate)) for _ in range(rnd.randint(1, 12))]
        p += 1
    rows += [(0, int(rnd.random() < 0.3)) for _ in range(6000)]
    rows += [(None, 1)] * 7 + [(p, None)] * 9
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, patient long, y int").repartition(5).cache()


@pytest.mark.parametrize("folds", [False, True])
def test_groups_stay_whole_and_classes_at_their_quotas(spark, patients, folds):
    out = (group_folds(patients, "y", "patient", 4) if folds else group_split(patients, "y", "patient")).cache()
    part = "fold" if folds else "is_test"
    assert out.count() == patients.count() and out.select("id").distinct().count() == out.count()
    assert out.groupBy("patient").agg(F.countDistinct(part).alias("k")).where("k > 1").count() == 0
    bound = {r.y: r.bound for r in deviation_bound(patients, "y", "patient").collect()}
    n = {r.y: r["count"] for r in patients.groupBy("y").count().collect()}
    got = {(r.y, r[part]): r["count"] for r in out.groupBy("y", part).count().collect()}
    share = {f: 0.25 for f in range(4)} if folds else {1: 0.2, 0: 0.8}
    for y in n:
        for k, s in share.items():
            assert abs(got.get((y, k), 0) - s * n[y]) <= bound[y]
    again = (group_folds(patients.repartition(3), "y", "patient", 4) if folds
             else group_split(patients.repartition(3), "y", "patient"))
    assert again.select("id", part).exceptAll(out.select("id", part)).count() == 0


def test_many_small_groups_are_exact_to_a_group(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 7000).alias("patient"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = group_split(df, "y", "patient")
    n = {r.y: (r.n, r.t) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert all(abs(t - 0.2 * c) <= 10 for c, t in n.values())
    parts = assign_groups(df, "y", "patient", [0.2], rows_per_task=2)  # every patient hot
    assert parts.where("part = 0").select("id").exceptAll(out.where("is_test = 1").select("id")).count() == 0
    assert group_split(df.limit(0), "y", "patient").count() == 0


def test_one_pass_split(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = approximate_split(df, "y", "id", {0: 0.1, 1: 0.4})
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.groupBy("y").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect():
        f = {0: 0.1, 1: 0.4}[r.y]
        assert abs(r.t - f * r.n) <= 5 * (r.n * f * (1 - f)) ** 0.5
    assert approximate_split(df, "y", "id", 1.0).where("is_test = 0").count() == 0


def test_cube_fits_equal_row_fits(spark):
    folds = frame(spark, SF_SMALL).withColumn("fold", (F.col("encounter_id") % 3).cast("int")).cache()
    cube = ML.fold_cube(folds)
    assert cube.agg(F.sum("n")).first()[0] == folds.count() > cube.count()
    for f, (counts, moments) in ML.cube_statistics(cube).items():
        train = folds.where(F.col("fold") != f)
        assert counts == ML.class_counts(train)
        one, two = ML.fit_logistic_fold(cube, f, counts, moments).stages[-1], ML.fit_logistic(train).stages[-1]
        assert np.allclose(one.coefficients.toArray(), two.coefficients.toArray(), atol=1e-6)
        assert abs(one.intercept - two.intercept) < 1e-6
    gradient = ML.logistic_gradient(ML.fit_logistic(train), train).collect()
    assert len(gradient) == len(FEATURE_COLUMNS) + 1 and all(abs(r.gradient) < 5e-7 for r in gradient)


def test_cross_validation_reads_all_scores_at_once(spark):
    got = ML.cross_validate(frame(spark, SF_SMALL), k=3, trees=5, max_depth=4).collect()
    assert sorted((r.model, r.fold) for r in got) == [(m, f) for m in ("Logistic Regression", "Random Forest") for f in range(3)]
    assert all(0.3 < r.roc_auc < 1 for r in got)


def test_metrics_by_key_equal_single_ones(spark):
    rnd = random.Random(1)
    rows = [(m, f, rnd.choice([0, 0, 1, None]), rnd.choice([rnd.random(), 0.5, None, float("nan")]))
            for m in ("a", "b", None) for f in range(2) for _ in range(rnd.randint(1, 400))]
    rows += [("only negatives", 0, 0, 0.5), ("only negatives", 0, 0, 0.7), ("nothing", 0, None, 0.1)]
    df = spark.createDataFrame(rows, "m string, f int, label int, score double").cache()
    for few in (M.FEW_KEYS, 0):
        old, M.FEW_KEYS = M.FEW_KEYS, few
        try:
            got = {(r.m, r.f): r[2:] for r in M.ranking_metrics_by_key(df, ["m", "f"], n_bins=9).collect()}
            curves = M.curves_by_key(df, ["m", "f"], n_bins=9).collect()
        finally:
            M.FEW_KEYS = old
        assert set(got) == {(m, f) for m, f, y, s in rows if y is not None and s is not None and s == s}
        for m, f in got:
            own = df.where(F.col("m").eqNullSafe(F.lit(m)) & (F.col("f") == f))
            want = tuple(M.ranking_metrics(own, n_bins=5).first())
            assert all(x is y is None or abs(x - y) < 1e-12 for x, y in zip(got[m, f], want))
            points = {(r.threshold, r.fpr, r.tpr) for r in curves if (r.m, r.f) == (m, f)}
            assert points == {tuple(r) for r in M.roc_curve(own, n_bins=5).collect()}
