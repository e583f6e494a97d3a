"""A fitted forest as tables (J-6, J-7, J-14): nodes, scores and importances by SQL means.

The node table has one row per node: tree, node (0 is the root), feature and
cut of its question (NULL in a leaf), ``yes`` (the child of rows with feature
<= cut), ``no``, the gain of the question, and w0, w1 (weight of each class
among the training rows that reached the node).

A row descends by joining its place (tree, node) with the questions, once per level; all
trees descend at once. The questions are broadcast in groups of whole trees
with at most ``MOST_NODES`` nodes, so what is sent is bounded whatever the size of the forest;
votes of the groups are added. Rows are combined again inside their own
task (a row's trees stand side by side), so the one shuffle carries a row
per scored row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FEATURE_COLUMNS, LABEL_COLUMN
from ..functions.cleaning import check_columns
from ..session import materialize, new_scratch

MOST_NODES = 1_000_000  # of the trees that descend together: about 40 MB
NODE_COLUMNS = ("tree", "node", "feature", "cut", "yes", "no", "gain", "w0", "w1")


@dataclass(frozen=True)
class Forest:
    """A node table, the largest number of questions on a path, and the trees with their nodes."""

    nodes: DataFrame
    depth: int
    sizes: dict[int, int]

    def groups(self, most: int) -> list[list[int]]:
        """Trees that descend together: at most ``most`` nodes, or one tree alone."""
        out: list[list[int]] = []
        held = 0
        for tree, size in sorted(self.sizes.items()):
            if not out or held + size > most:
                out.append([])
                held = 0
            out[-1].append(tree)
            held += size
        return out


def forest_from_nodes(nodes: DataFrame) -> Forest:
    """A forest from any node table. Its depth is found by walking down from the roots,
    one small join a level; a table whose children lead back up raises."""
    check_columns("forest_from_nodes", nodes, *NODE_COLUMNS)
    sizes = {r["tree"]: r["count"] for r in nodes.groupBy("tree").count().collect()}
    inner = nodes.where("feature IS NOT NULL").select(
        "tree", "node", F.explode(F.array("yes", "no")).alias("child"))
    at, depth = nodes.where("node = 0").select("tree", "node"), 0
    while True:
        at = materialize(at.join(inner, ["tree", "node"]).select("tree", F.col("child").alias("node")))
        if at.isEmpty():
            return Forest(nodes, depth, sizes)
        depth += 1
        if depth > max(sizes.values()):
            raise ValueError("the children of a node lead back to it")


def forest_nodes(model: PipelineModel, features: Sequence[str] = FEATURE_COLUMNS) -> Forest:
    """J-6 as a table: the nodes of a fitted forest, read from the files Spark saves it in."""
    forest = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = new_scratch(spark, "forest")
    forest.write().overwrite().save(path)
    n, split = "nodeData", "nodeData.split"
    names = F.array(*map(F.lit, features))
    inner = F.col(f"{n}.leftChild") >= 0

    def of_inner(value: Column) -> Column:
        return F.when(inner, value)

    saved = spark.read.parquet(path + "/data")
    nodes = saved.select(
        F.col("treeID").alias("tree"), F.col(f"{n}.id").alias("node"),
        of_inner(F.get(names, F.col(f"{split}.featureIndex"))).alias("feature"),
        of_inner(F.get(F.col(f"{split}.leftCategoriesOrThreshold"), F.lit(0))).alias("cut"),
        of_inner(F.col(f"{n}.leftChild")).alias("yes"), of_inner(F.col(f"{n}.rightChild")).alias("no"),
        of_inner(F.col(f"{n}.gain")).alias("gain"),
        F.get(F.col(f"{n}.impurityStats"), F.lit(0)).alias("w0"),
        F.get(F.col(f"{n}.impurityStats"), F.lit(1)).alias("w1"))
    trees = forest.trees
    return Forest(nodes, max(t.depth for t in trees), {i: t.numNodes for i, t in enumerate(trees)})


def descend(rows: DataFrame, forest: Forest, trees: Sequence[int],
            features: Sequence[str] = FEATURE_COLUMNS, path: bool = False) -> DataFrame:
    """``rows`` once per tree, with ``tree`` and ``node``: the leaf reached, or with
    ``path`` an array of all nodes passed. A NULL or NaN feature answers no, as in Spark."""
    inner = forest.nodes.where(F.col("feature").isNotNull() & F.col("tree").isin(list(trees)))
    inner = inner.select(F.col("tree").alias("__tree"), F.col("node").alias("__node"),
                         F.col("feature").alias("__feature"), F.col("cut").alias("__cut"),
                         F.col("yes").alias("__yes"), F.col("no").alias("__no"))
    if sum(forest.sizes[t] for t in trees) <= MOST_NODES:  # size known, not estimated
        inner = F.broadcast(inner)
    answer = F.lit(None).cast("double")
    for f in features:
        answer = F.when(F.col("__feature") == f, F.col(f).cast("double")).otherwise(answer)
    out = rows.withColumn("tree", F.explode(F.array(*map(F.lit, trees)))).withColumn("node", F.lit(0))
    if path:
        out = out.withColumn("path", F.array("node"))
    for _ in range(forest.depth):
        child = F.when(F.coalesce(answer <= F.col("__cut"), F.lit(False)), F.col("__yes")).otherwise(F.col("__no"))
        columns = [*rows.columns, "tree"]
        joined = out.join(inner, (F.col("tree") == F.col("__tree")) & (F.col("node") == F.col("__node")), "left")
        moved = F.col("__feature").isNotNull()
        step = [F.when(moved, child).otherwise(F.col("node")).alias("node")]
        if path:
            step.append(F.when(moved, F.concat("path", F.array(child))).otherwise(F.col("path")).alias("path"))
        out = joined.select(*columns, *step)
    return out


def score_nodes(rows: DataFrame, forest: Forest, features: Sequence[str] = FEATURE_COLUMNS,
                id_col: str = "encounter_id", label: str = LABEL_COLUMN,
                most_nodes: int = MOST_NODES) -> DataFrame:
    """J-7 by descent: (id, label, score). A tree votes with the share of class 1 in
    the leaf; the score is the mean of the votes (of the trees whose leaf has weight)."""
    keyed = rows.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"),
                        F.col(label).cast("int").alias("__label"), *features)
    leaves = forest.nodes.where("feature IS NULL").select(
        F.col("tree").alias("__t"), F.col("node").alias("__n"),
        F.try_divide("w1", F.col("w0") + F.col("w1")).alias("vote"))
    parts = []
    for trees in forest.groups(most_nodes):
        own = leaves.where(F.col("__t").isin(trees))
        if sum(forest.sizes[t] for t in trees) <= most_nodes:
            own = F.broadcast(own)
        at = descend(keyed, forest, trees, features)
        parts.append(at.join(own, (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n")))
                     .groupBy("__row", "__id", "__label")
                     .agg(F.sum("vote").alias("votes"), F.count("vote").alias("trees")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        out = out.groupBy("__row", "__id", "__label").agg(F.sum("votes").alias("votes"),
                                                          F.sum("trees").alias("trees"))
    return out.select(F.col("__id").alias("id"), F.col("__label").alias("label"),
                      F.try_divide("votes", F.col("trees")).alias("score"))


def gini(w0: Column, w1: Column) -> Column:
    """Impurity of two class weights; 0 without weight."""
    total = w0 + w1
    return F.when(total > 0, 1 - (w0 / total) * (w0 / total) - (w1 / total) * (w1 / total)).otherwise(F.lit(0.0))


def refit_nodes(forest: Forest, rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
                label: str = LABEL_COLUMN, weight: str = "weight",
                most_nodes: int = MOST_NODES) -> Forest:
    """The same questions with class weights and gains measured on ``rows`` (a node that no row
    reaches has weight 0). Rows of equal features and label descend once, with their summed weight."""
    grouped = rows.groupBy(*features, label).agg(F.sum(weight).alias("__w"))
    parts = [descend(grouped, forest, trees, features, path=True)
             .select("tree", F.explode("path").alias("node"), label, "__w")
             .groupBy("tree", "node").agg(F.sum(F.when(F.col(label) == 0, F.col("__w")).otherwise(0.0)).alias("w0"),
                                          F.sum(F.when(F.col(label) == 1, F.col("__w")).otherwise(0.0)).alias("w1"))
             for trees in forest.groups(most_nodes)]
    weights = parts[0]
    for p in parts[1:]:
        weights = weights.unionByName(p)
    nodes = (forest.nodes.select("tree", "node", "feature", "cut", "yes", "no")
             .join(weights, ["tree", "node"], "left").fillna(0.0, ["w0", "w1"]))
    nodes = materialize(nodes.withColumn("impurity", gini(F.col("w0"), F.col("w1"))))
    own = F.col("w0") + F.col("w1")
    child = nodes.select("tree", (F.col("w0") + F.col("w1")).alias("w"), "impurity", "node")
    yes = child.select("tree", F.col("node").alias("yes"), F.col("w").alias("wy"), F.col("impurity").alias("iy"))
    no = child.select("tree", F.col("node").alias("no"), F.col("w").alias("wn"), F.col("impurity").alias("i_n"))
    gain = F.when(F.col("feature").isNotNull(), F.when(
        own > 0, F.col("impurity") - F.col("wy") / own * F.col("iy") - F.col("wn") / own * F.col("i_n")
    ).otherwise(F.lit(0.0)))
    fitted = (nodes.join(yes, ["tree", "yes"], "left").join(no, ["tree", "no"], "left")
              .select("tree", "node", "feature", "cut", "yes", "no", gain.alias("gain"), "w0", "w1"))
    return Forest(fitted, forest.depth, forest.sizes)


def node_importances(forest: Forest, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """J-14 from node gains: (feature, importance) of every feature, largest first. A tree's
    gains times the weight they were measured on sum to 1; the forest's are their mean
    over the trees that ask anything."""
    gains = (forest.nodes.where("feature IS NOT NULL").groupBy("tree", "feature")
             .agg(F.sum(F.col("gain") * (F.col("w0") + F.col("w1"))).alias("gain")))
    shares = gains.join(gains.groupBy("tree").agg(F.sum("gain").alias("whole")), "tree").where("whole > 0")
    summed = shares.groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("part"))
    spark = forest.nodes.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, features))).alias("feature"))
    # one row per feature on either side
    return (every.join(F.broadcast(summed), "feature", "left")
            .withColumn("total", F.sum("part").over(Window.partitionBy()))
            .select("feature", F.coalesce(F.try_divide("part", F.col("total")), F.lit(0.0)).alias("importance"))
            .orderBy(F.col("importance").desc(), "feature"))
