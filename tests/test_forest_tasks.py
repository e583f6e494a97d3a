"""Trees grown in tasks: equal to Spark's, scored without the driver, in a fixed number of jobs."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ratelens.constants import FEATURE_COLUMNS
from ratelens.ml import forest as FO
from ratelens.ml import metrics as M
from ratelens.ml import models as ML
from ratelens.ml import trees as TR
from ratelens.ml.split import stratified_folds
from ratelens.plans.catalog import frame
from conftest import SF_SMALL

LABEL = "readmitted_flag"


@pytest.fixture(scope="module")
def rows(spark):
    return ML.materialize(frame(spark, SF_SMALL))


def _both(monkeypatch, groups, *args, **named):
    """The same fit by tasks and by Spark's induction."""
    tasks = ML.fit_forest_groups(groups, *args, **named).stages[-1]
    monkeypatch.setattr(FO, "GROUPS_IN_TASK", 0)
    spark_s = ML.fit_forest_groups(groups, *args, **named).stages[-1]
    monkeypatch.undo()
    return tasks, spark_s


def _same_trees(a, b):
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    assert (a.numClasses, a.numFeatures, a.getNumTrees) == (b.numClasses, b.numFeatures, b.getNumTrees)
    assert a.featureImportances.toArray().tolist() == b.featureImportances.toArray().tolist()
    for x, y in zip(a._java_obj.trees(), b._java_obj.trees()):  # down the path of answers yes
        x, y = x.rootNode(), y.rootNode()
        while True:
            assert list(x.impurityStats().stats()) == list(y.impurityStats().stats())
            assert (x.impurity(), x.prediction(), x.impurityStats().rawCount()) == (
                y.impurity(), y.prediction(), y.impurityStats().rawCount())
            if not hasattr(x, "leftChild") or "Leaf" in x.getClass().getName():
                break
            assert x.gain() == y.gain()
            x, y = x.leftChild(), y.leftChild()


def test_trees_are_those_of_spark(spark, rows, monkeypatch):
    _same_trees(*_both(monkeypatch, ML.row_groups(rows), trees=3))


def test_trees_of_three_classes_and_few_features(spark, monkeypatch):
    groups = spark.range(400).selectExpr("cast(id % 23 as int) AS x", "id * 0.37 AS z", "0 AS same",
                                         "cast((id * 7919 % 11) % 3 as int) AS y", "id % 3 + 1 AS n")
    _same_trees(*_both(monkeypatch, groups, ["x", "z"], "y", trees=2))  # both features tried at every node
    _same_trees(*_both(monkeypatch, groups, ["same", "x", "z"], "y", trees=2))  # one of them constant


def test_nodes_that_find_no_room_wait(spark, rows):
    # 0 MB: one node at a time; the next one draws its features again
    groups = ML.materialize(ML.row_groups(rows).withColumn("w", F.col("n") + 0.25).repartition(1, *FEATURE_COLUMNS)
                            .sortWithinPartitions(*FEATURE_COLUMNS, LABEL))
    held = groups.toArrow()
    values = [held[f].to_numpy().astype(np.float64) for f in FEATURE_COLUMNS]
    assembled = VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="features").transform(groups)
    want = ML.tree_model(LABEL, "w", 4, 7, 4096).setMaxMemoryInMB(0).fit(assembled)
    nodes = TR.forest_nodes(ML.PipelineModel(stages=[want])).nodes.orderBy("node").collect()
    labels = held[LABEL].to_numpy().astype(np.int64)
    got = FO.grow_tree(values, labels, held["w"].to_numpy(), 2, 4, 7, 0)
    assert [(r.node, r.w0, r.w1) for r in nodes] == list(zip(got["id"].tolist(), *got["stats"].T.tolist()))
    asked = [(r.feature, r.cut, r.yes, r.no, r.gain) for r in nodes if r.feature is not None]
    inner = np.nonzero(got["feature"] >= 0)[0]
    assert asked == [(FEATURE_COLUMNS[got["feature"][i]], got["cut"][i], got["yes"][i], got["no"][i], got["gain"][i])
                     for i in inner] and len(asked) > 4
    other = FO.grow_tree(values, labels, held["w"].to_numpy(), 2, 4, 7, 1024)
    assert other["feature"].tolist() != got["feature"].tolist()  # so the order of draws is tested


def test_scores_without_the_driver_are_those_of_spark(spark, rows):
    groups = ML.row_groups(rows)
    grown = ML.fit_forest_groups(groups, trees=7, in_driver=False)
    model = ML.fit_forest_groups(groups, trees=7)
    want = sorted(tuple(r) for r in ML.score(model, rows.unionAll(rows.limit(9))).collect())
    for tasks in (1, 3, 12):
        got = FO.scores(grown, rows.unionAll(rows.limit(9)).repartition(5), "encounter_id", LABEL, tasks).collect()
        assert sorted(tuple(r) for r in got) == want  # to the last bit
    assert FO.scores(grown, rows.limit(0), "encounter_id", LABEL).count() == 0
    with pytest.raises(Exception, match="NULL or NaN"):
        FO.scores(grown, rows.limit(3).withColumn("age_risk", F.lit(None).cast("int")), "encounter_id", LABEL).collect()


def test_a_forest_takes_a_fixed_number_of_jobs(spark, rows):
    def jobs(trees):
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        ML.fit_forest(rows, trees=trees)
        return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before)

    few = jobs(2)
    assert jobs(9) == few < 25  # one a tree and level before: 9 trees, 150 jobs and more


def test_a_weighted_row_counts_as_so_many(spark):
    scored = spark.range(500).selectExpr("cast(id % 3 as string) AS model", "cast(id % 7 = 0 AS int) AS label",
                                         "(id * 31 % 17) / 17.0D AS score", "id % 4 AS n")
    copies = scored.select("model", "label", "score", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    want = M.ranking_metrics_by_key(copies, ["model"]).orderBy("model").collect()
    assert M.ranking_metrics_by_key(scored, ["model"], weight="n").orderBy("model").collect() == want


def test_cross_validation_by_rows(spark, rows):
    # ids that come twice are joined with both of their folds' rows, and every one counts
    rows = ML.materialize(rows.unionAll(rows.where("encounter_id % 9 = 0")))
    got = {(r.model, r.fold): r.roc_auc for r in ML.cross_validate(rows, 3, trees=4, max_depth=8).collect()}
    folds = ML.materialize(rows.join(stratified_folds(rows.select("encounter_id", LABEL), LABEL, "encounter_id", 3)
                                     .select("encounter_id", "fold"), "encounter_id"))
    for f in range(3):
        train, test = folds.where(F.col("fold") != f), folds.where(F.col("fold") == f)
        forest = ML.score(ML.fit_forest(train, trees=4, max_depth=8), test)
        assert got["Random Forest", f] == pytest.approx(M.ranking_metrics(forest).first().roc_auc, abs=1e-12)
        logistic = ML.score(ML.fit_logistic(train), test)
        assert got["Logistic Regression", f] == pytest.approx(M.ranking_metrics(logistic).first().roc_auc, abs=1e-6)
    assert len(got) == 6
