from pyspark.sql import functions as F

from ratelens.ml import models as ML
from ratelens.ml.split import assign_parts, stratified_folds, stratified_split
from ratelens.plans.catalog import frame
from conftest import SF_SMALL


def _frame(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("encounter_id"),
                                 (F.col("id") % 7 == 0).cast("int").alias("y"))


def test_split_exact_quota_disjoint_deterministic(spark):
    df = _frame(spark)
    for bits in (16, 2):  # 2 bits forces straddling bins
        out = assign_parts(df, "y", "encounter_id", [0.2], out="p", bits=bits)
        counts = {(r.y, r.p): r["count"] for r in out.groupBy("y", "p").count().collect()}
        n1 = 2000 // 7 + 1
        assert counts[(1, 0)] == round(0.2 * n1) and counts[(0, 0)] == round(0.2 * (2000 - n1))
        assert out.count() == 2000 and out.select("encounter_id").distinct().count() == 2000
    a = stratified_split(df, "y", "encounter_id").filter("is_test = 1").select("encounter_id")
    b = stratified_split(df, "y", "encounter_id").filter("is_test = 1").select("encounter_id")
    assert a.exceptAll(b).count() == 0


def test_split_bins_agree(spark):
    df = _frame(spark)
    fine = assign_parts(df, "y", "encounter_id", [0.2], out="p", bits=16)
    coarse = assign_parts(df, "y", "encounter_id", [0.2], out="p", bits=2)
    assert fine.exceptAll(coarse).count() == 0


def test_folds(spark):
    out = stratified_folds(_frame(spark), "y", "encounter_id", k=5)
    sizes = sorted(r["count"] for r in out.groupBy("fold").count().collect())
    assert sum(sizes) == 2000 and max(sizes) - min(sizes) <= 2
    per_class = out.groupBy("fold", "y").count().collect()
    assert all(abs(r["count"] - (57.2 if r.y == 1 else 342.8)) <= 1 for r in per_class)


def test_weights_sum_to_n(spark):
    df = ML.balanced_weights(_frame(spark), "y")
    total = df.agg(F.sum("weight")).first()[0]
    assert abs(total - 2000) < 1e-9


def test_models_fit_small(spark):
    mf = frame(spark, SF_SMALL).cache()
    train = mf
    lr = ML.fit_logistic(train)
    coefs = ML.coefficients(lr).collect()
    assert len(coefs) == 9
    scaled = lr.stages[1].transform(lr.stages[0].transform(ML.balanced_weights(train)))
    from pyspark.ml.stat import Summarizer
    mean = scaled.select(Summarizer.mean(F.col("features"))).first()[0]
    assert max(abs(v) for v in mean.toArray()) < 1e-9
    rf = ML.fit_forest(train, trees=10, max_depth=5)
    imps = ML.importances(rf).collect()
    assert abs(sum(r.importance for r in imps) - 1.0) < 1e-9
    scored = ML.score(rf, mf)
    assert scored.columns == ["id", "label", "score"]
    assert scored.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    mf.unpersist()


def test_evaluate_best_flow(spark):
    split = stratified_split(frame(spark, SF_SMALL), "readmitted_flag", "encounter_id").cache()
    out = ML.evaluate_best(split.filter("is_test = 0"), split.filter("is_test = 1"))
    comp = out["comparison"].collect()
    assert [r.model for r in comp][-1] == "Baseline (random)"
    assert sum(r.best for r in comp) == 1
    n_test = split.filter("is_test = 1").count()
    assert sum(r.n for r in out["confusion"].collect()) == n_test
    assert len(out["sweep"].collect()) == 16
    rep = {r["class"]: r for r in out["report"].collect()}
    assert rep["accuracy"].support == n_test
    split.unpersist()


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(20000).select(F.col("id").alias("encounter_id"),
                                   (F.col("id") % 997).alias("patient_nbr"),
                                   (F.col("id") % 7 == 0).cast("int").alias("y"))
    out = stratified_split(df, "y", "encounter_id", group_col="patient_nbr")
    mixed = out.groupBy("patient_nbr").agg(F.countDistinct("is_test").alias("k")).filter("k > 1")
    assert mixed.count() == 0
    share = out.agg(F.avg("is_test")).first()[0]
    assert 0.15 < share < 0.25


def test_split_keeps_rows_with_null_label(spark):
    df = spark.range(500).select(F.col("id").alias("encounter_id"),
                                 F.when(F.col("id") % 10 == 0, None)
                                 .otherwise((F.col("id") % 3 == 0).cast("int")).alias("y"))
    out = stratified_split(df, "y", "encounter_id")
    assert out.count() == 500
    null_test = out.filter(F.col("y").isNull() & (F.col("is_test") == 1)).count()
    assert null_test == 10  # round(0.2 * 50)
