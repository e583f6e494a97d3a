import math

import numpy as np
import pytest

from ratelens.ml import metrics as M


def brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(labels, scores):
    P = sum(labels)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for l, s in zip(labels, scores) if s >= t and l == 1)
        pred = sum(1 for s in scores if s >= t)
        r = tp / P
        ap += (r - prev_r) * tp / pred
        prev_r = r
    return ap


def _scored(spark, labels, scores):
    return spark.createDataFrame([(i, l, float(s)) for i, (l, s) in enumerate(zip(labels, scores))],
                                 "id long, label int, score double")


@pytest.mark.parametrize("n_bins", [1024, 4])
def test_tied_scores(spark, n_bins):
    labels = [1, 0, 1, 0, 0, 1]
    scores = [0.8, 0.8, 0.3, 0.3, 0.3, 0.9]
    df = _scored(spark, labels, scores)
    assert math.isclose(M.roc_auc(df, n_bins=n_bins).first()[0], brute_auc(labels, scores), rel_tol=1e-12)
    assert math.isclose(M.average_precision(df, n_bins=n_bins).first()[0],
                        brute_ap(labels, scores), rel_tol=1e-9)


def test_many_distinct_scores_multiple_bins(spark):
    rng = np.random.default_rng(1)
    scores = np.round(rng.random(3000), 3)
    labels = (rng.random(3000) < scores * 0.4).astype(int).tolist()
    df = _scored(spark, labels, scores.tolist())
    auc = M.roc_auc(df, n_bins=16).first()[0]
    ap = M.average_precision(df, n_bins=16).first()[0]
    assert math.isclose(auc, brute_auc(labels, scores.tolist()), rel_tol=1e-12)
    assert math.isclose(ap, brute_ap(labels, scores.tolist()), rel_tol=1e-9)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                       metricName="areaUnderROC", numBins=0)
    assert math.isclose(ev.evaluate(df.withColumn("label", df.label.cast("double"))), auc, rel_tol=1e-9)
    curve = M.roc_curve(df, n_bins=16).collect()
    assert curve[-1].fpr == 1.0 and curve[-1].tpr == 1.0
    assert all(a.fpr <= b.fpr for a, b in zip(curve, curve[1:]))


def test_sweep_no_positive_prediction(spark):
    df = _scored(spark, [1, 0, 0, 1], [0.05] * 4)
    rows = M.threshold_sweep(df).collect()
    assert len(rows) == 16 and rows[0].threshold == 0.1 and rows[-1].threshold == 0.85
    assert all(r.precision == 0 and r.recall == 0 and r.f1 == 0 for r in rows)


def test_sweep_matches_loop(spark):
    rng = np.random.default_rng(2)
    scores = rng.random(500).round(2)
    labels = (rng.random(500) < 0.3).astype(int)
    rows = M.threshold_sweep(_scored(spark, labels.tolist(), scores.tolist())).collect()
    for r, t in zip(rows, M.sweep_grid()):
        pred = scores >= t
        tp = int((pred & (labels == 1)).sum())
        fp = int((pred & (labels == 0)).sum())
        assert (r.tp, r.fp) == (tp, fp)


def test_confusion_and_report(spark):
    labels = [1, 1, 0, 0, 0]
    scores = [0.9, 0.2, 0.6, 0.1, 0.5]
    df = _scored(spark, labels, scores)
    cells = {(r.actual, r.predicted): r.n for r in M.confusion(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 1}
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert math.isclose(rep["Readmitted"].precision, 1 / 3)
    assert math.isclose(rep["Readmitted"].recall, 0.5)
    assert rep["Not Readmitted"].support == 3 and rep["accuracy"].f1 == 0.4
    assert math.isclose(rep["macro avg"].recall, (0.5 + 1 / 3) / 2)


def test_cv_summary_population_std(spark):
    df = spark.createDataFrame([("m", 0, 0.6), ("m", 1, 0.8)], "model string, fold int, roc_auc double")
    r = M.cv_summary(df).first()
    assert math.isclose(r["mean"], 0.7) and math.isclose(r["std"], 0.1) and r["scores"] == [0.6, 0.8]


def test_null_label_or_score_excluded_everywhere(spark):
    rows = [(0, 1, 0.9), (1, 0, 0.2), (2, 1, 0.6), (3, 0, 0.7), (4, None, 0.95), (5, 1, None)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    clean = df.dropna()
    assert M.roc_auc(df).first()[0] == M.roc_auc(clean).first()[0]
    assert [tuple(r) for r in M.threshold_sweep(df).collect()] == \
        [tuple(r) for r in M.threshold_sweep(clean).collect()]
    assert sum(r.n for r in M.confusion(df).collect()) == 4
