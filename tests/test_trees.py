"""A fitted forest as tables: nodes, scores by descent, importances, refitted weights."""
import pytest
from pyspark.sql import functions as F

from ratelens.constants import FEATURE_COLUMNS
from ratelens.ml import models as ML
from ratelens.ml import trees as TR
from ratelens.plans.catalog import frame
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    rows = frame(spark, SF_SMALL).cache()
    return rows, ML.fit_forest(rows, trees=7, max_depth=9)


def test_scores_equal_those_of_spark(spark, fitted):
    rows, model = fitted
    forest = TR.forest_nodes(model)
    assert forest.nodes.count() == sum(forest.sizes.values())
    assert TR.forest_from_nodes(forest.nodes).depth == forest.depth
    want = {r.id: r.score for r in ML.score(model, rows).collect()}
    for most in (TR.MOST_NODES, 60):  # 60: several groups of trees
        got = TR.score_nodes(rows, forest, most_nodes=most).collect()
        assert len(got) == len(want)
        assert all(abs(r.score - want[r.id]) < 1e-12 for r in got)
    twice = TR.score_nodes(rows.unionAll(rows.limit(5)), forest)
    assert twice.count() == len(want) + 5


def test_importances_equal_those_of_spark(spark, fitted):
    _, model = fitted
    want = {r.feature: r.importance for r in ML.importances(model).collect()}
    got = {r.feature: r.importance for r in TR.node_importances(TR.forest_nodes(model)).collect()}
    assert set(got) == set(FEATURE_COLUMNS)
    assert all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_refitted_weights_by_counting(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1.0), (2, 1, 2.0), (3, 1, 1.0), (7, 0, 4.0), (9, 1, 1.0), (9, 1, 1.0), (None, 0, 1.0)],
        "x int, y int, weight double")
    nodes = spark.createDataFrame(
        [(0, 0, "x", 2.5, 1, 2, None, None, None), (0, 1, None, None, None, None, None, None, None),
         (0, 2, "x", 8.0, 3, 4, None, None, None), (0, 3, None, None, None, None, None, None, None),
         (0, 4, "x", 100.0, 5, 6, None, None, None), (0, 5, None, None, None, None, None, None, None),
         (0, 6, None, None, None, None, None, None, None), (1, 0, None, None, None, None, None, None, None)],
        "tree int, node int, feature string, cut double, yes int, no int, gain double, w0 double, w1 double")
    forest = TR.refit_nodes(TR.forest_from_nodes(nodes), rows, ["x"], "y")
    got = {(r.tree, r.node): r for r in forest.nodes.collect()}
    weights = {k: (r.w0, r.w1) for k, r in got.items()}
    # a missing value answers no all the way down
    assert weights == {(0, 0): (6, 5), (0, 1): (1, 2), (0, 2): (5, 3), (0, 3): (4, 1), (0, 4): (1, 2),
                       (0, 5): (0, 2), (0, 6): (1, 0), (1, 0): (6, 5)}
    gini = lambda a, b: 1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2
    assert got[0, 0].gain == pytest.approx(gini(6, 5) - 3 / 11 * gini(1, 2) - 8 / 11 * gini(5, 3))
    assert got[0, 4].gain == pytest.approx(gini(1, 2)) and got[0, 1].gain is None
    scores = TR.score_nodes(rows.withColumn("id", F.lit(7)), forest, ["x"], "id", "y").collect()
    assert sorted(round(r.score, 9) for r in scores) == sorted(
        round((v + 5 / 11) / 2, 9) for v in (2 / 3, 2 / 3, 1 / 5, 1 / 5, 1, 1, 0))
    assert TR.node_importances(forest, ["x", "z"]).collect() == [("x", 1.0), ("z", 0.0)]


def test_a_table_with_a_cycle_raises(spark):
    nodes = spark.createDataFrame([(0, 0, "x", 1.0, 0, 0, None, 1.0, 1.0)],
                                  "tree int, node int, feature string, cut double, yes int, no int, "
                                  "gain double, w0 double, w1 double")
    with pytest.raises(ValueError):
        TR.forest_from_nodes(nodes)


def test_questions_are_broadcast_and_nothing_is_shuffled_but_scores(spark, fitted):
    rows, model = fitted
    plan = TR.score_nodes(rows, TR.forest_nodes(model))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_draws_of_a_group_are_those_of_its_rows(spark):
    groups = spark.createDataFrame([(i, i % 2, 1000 if i == 0 else 1) for i in range(300)], "x int, y int, n long")
    draws = {r.x: r.draws for r in ML.with_draws(groups.repartition(5), 200).collect()}
    assert draws == {r.x: r.draws for r in ML.with_draws(groups.coalesce(1), 200).collect()}
    hot, ones = draws[0], [d for x in range(1, 300) for d in draws[x]]
    for drawn, want in ((hot, 1000), (ones, 1)):  # Poisson: variance and mean are n
        mean = sum(drawn) / len(drawn)
        assert mean == pytest.approx(want, rel=0.03)
        assert sum((d - mean) ** 2 for d in drawn) / len(drawn) == pytest.approx(want, rel=0.3)


def test_a_forest_reads_distinct_rows_and_follows_the_rows_alone(spark, fitted):
    rows, _ = fitted
    rows = rows.limit(200)
    copies = rows.crossJoin(spark.range(40)).cache()
    a, b = (ML.fit_forest(copies.repartition(p), trees=3, max_depth=6).stages[-1] for p in (1, 6))
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:] and a.getNumTrees == 3
    distinct = rows.select(*FEATURE_COLUMNS, "readmitted_flag").distinct().count()
    for tree in a._java_obj.trees():  # instances and weight that reached the root
        assert tree.rootNode().impurityStats().rawCount() <= distinct
        assert tree.rootNode().impurityStats().count() == pytest.approx(40 * 200, rel=0.1)
    copies.unpersist()


def test_every_value_is_a_possible_cut(spark):
    # 15,000 groups, one value of x that decides the class: it is seen though few rows have it
    groups = spark.range(15000).selectExpr("id AS z", "CASE WHEN id < 3 THEN 1 ELSE 0 END AS x",
                                           "CASE WHEN id < 3 THEN 1 ELSE 0 END AS y", "5L AS n")
    assert ML.split_bins(groups, ["x"]) ** 2 >= 15000
    forest = ML.fit_forest_groups(groups.select("x", "y", "z", "n"), ["x"], "y", trees=4, max_depth=2).stages[-1]
    assert all(t.depth == 1 for t in forest.trees)
