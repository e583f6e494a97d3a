"""Model frame, class weights, the two classifiers and their reports
(J-1, J-3 .. J-7, J-12 .. J-15, J-19).

Training runs on Spark ML (L-BFGS for logistic regression) and in tasks (the forest's
trees, ``forest``; Spark's tree induction for very many distinct rows); coefficients, a
forest's nodes, importances and metric scalars come back to the driver.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import isqrt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LogisticRegression, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..constants import (CV_FOLDS, FEATURE_COLUMNS, LABEL_COLUMN,
                         LR_MAX_ITER, RANDOM_BASELINE_AUC, RANDOM_STATE,
                         RF_TREES)
from ..functions.cleaning import check_columns
from ..functions.flags import engineer_features
from ..session import materialize
from . import forest as FO
from .metrics import (classification_report, confusion, ranking_metrics,
                      ranking_metrics_by_key, threshold_sweep)
from .split import stratified_folds

RF_MAX_DEPTH = 30  # unlimited depth is not available; this is Spark's largest
LR_TOL = 1e-12  # relative change at which the fit ends: its gradient is then 0 at 6 digits
GROUPS_PER_TASK = 50_000  # groups of equal rows in one partition of a forest's fit
TREES_AT_ONCE = 8  # trees of a forest whose fits are submitted together
MAX_CLASSES = 1000  # of a label; more is an id, not a class


def fixed_layout(df: DataFrame, id_col: str = "encounter_id",
                 partitions: int | None = None) -> DataFrame:
    """Rows in a partitioning that depends on the data and ``partitions``
    alone. The forest draws its bootstrap per partition, so this makes a fit
    the same on any number of cores. The default is the session's number of
    shuffle partitions; give a number to compare sessions."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, id_col).sortWithinPartitions(id_col)


def model_frame(enc: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
                label: str = LABEL_COLUMN, id_col: str = "encounter_id") -> DataFrame:
    """J-1: id, features and label; rows with a missing value dropped."""
    if label not in enc.columns:
        enc = engineer_features(enc)
    check_columns("model_frame", enc, id_col, label, *features)
    return enc.select(id_col, *features, label).dropna(subset=[*features, label])


def class_counts(df: DataFrame, label: str = LABEL_COLUMN) -> dict[int, int]:
    """Rows per class (one small aggregate; raises beyond MAX_CLASSES classes)."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return {r[0]: r[1] for r in rows}


def balanced_weights(df: DataFrame, label: str = LABEL_COLUMN,
                     out: str = "weight", counts: dict[int, int] | None = None) -> DataFrame:
    """J-3: weight n / (classes * n_class) per row, so weights sum to n."""
    counts = class_counts(df, label) if counts is None else counts
    n, k = sum(counts.values()), len(counts)
    w = None
    for cls, cnt in counts.items():
        val = F.lit(n / (k * cnt))
        w = F.when(F.col(label) == cls, val) if w is None else w.when(F.col(label) == cls, val)
    return df.withColumn(out, w)


def class_weight_table(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    """J-3 as a table: class, n, weight (one pass; totals from a window over
    the per-class rows)."""
    everything = Window.partitionBy()
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("weight", F.sum("n").over(everything)
                        / (F.count(F.lit(1)).over(everything) * F.col("n")))
            .orderBy(label))


def feature_moments(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """J-4: mean and population standard deviation per feature, in one pass."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"),
                      F.col(f"s_{f}").alias("sd")) for f in features]
    return (df.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                   *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
            .select(F.inline(F.array(*cells))))


def logistic_model(moments: Mapping[str, tuple[float, float]], label: str = LABEL_COLUMN,
                   weight: str = "weight", n_train: int | None = None,
                   max_iter: int = LR_MAX_ITER, tol: float = LR_TOL) -> Pipeline:
    """J-4 + J-5: standardise by the given (mean, sd) per feature, then
    balanced logistic regression. A constant feature is only centred.

    The L2 strength ``1 / n_train`` gives the same objective as C = 1 with
    balanced weights (whose sum is n_train); features are already scaled,
    so Spark's internal standardisation is off.
    """
    reg = 1.0 / n_train if n_train else 0.0
    scaled = ", ".join(f"(`{f}` - {m!r}D) / {s or 1.0!r}D AS `__z_{f}`"
                       for f, (m, s) in moments.items())
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__z_{f}" for f in moments], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight,
                           maxIter=max_iter, tol=tol, regParam=reg, elasticNetParam=0.0,
                           standardization=False),
    ])


def tree_model(label: str = LABEL_COLUMN, weight: str = "weight", max_depth: int = RF_MAX_DEPTH,
               seed: int = RANDOM_STATE, max_bins: int = 32) -> RandomForestClassifier:
    """J-6, one tree: sqrt(features) tried per split, rows as often as ``weight`` says (the
    draws are in it, so Spark draws none of its own).

    With ``max_bins`` above the distinct values of each feature
    (``split_bins``) every split point between two values is considered.
    """
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol=weight,
                                  numTrees=1, bootstrap=False, maxDepth=max_depth, seed=seed,
                                  maxBins=max_bins, featureSubsetStrategy="sqrt",
                                  # speed only: more nodes per data pass, node ids cached
                                  # (one narrow step a level, too few to need checkpoints)
                                  maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=-1)


def fit_logistic(train: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
                 label: str = LABEL_COLUMN, group: bool = True) -> PipelineModel:
    """Balanced logistic regression. Rows with equal features and label are
    one row with their summed weight (``group``): the objective is the same,
    the passes are over the distinct rows."""
    counts = class_counts(train, label)  # one small aggregate gives n as well
    moments = {r["feature"]: (r["mean"] or 0.0, r["sd"] or 0.0)
               for r in feature_moments(train, features).collect()}
    weighted = balanced_weights(train, label, counts=counts)
    if group:
        weighted = weighted.groupBy(*features, label).agg(F.sum("weight").alias("weight")).cache()
    try:
        return logistic_model(moments, label, n_train=sum(counts.values())).fit(weighted)
    finally:
        weighted.unpersist()


def logistic_gradient(model: PipelineModel, train: DataFrame,
                      features: Sequence[str] = FEATURE_COLUMNS,
                      label: str = LABEL_COLUMN) -> DataFrame:
    """J-5 / J-13 checked: the gradient of the fitted objective (weighted mean log loss and L2
    penalty, on scaled features) at the coefficients, one row per feature and one for the
    intercept. All are 0 at the optimum. One aggregate over rows grouped by features and label."""
    lr = model.stages[-1]
    counts = class_counts(train, label)
    n = sum(counts.values())
    moments = {r["feature"]: (r["mean"] or 0.0, (r["sd"] or 0.0) or 1.0)
               for r in feature_moments(train, features).collect()}
    grouped = (balanced_weights(train, label, counts=counts).groupBy(*features, label)
               .agg(F.sum("weight").alias("weight")))
    beta = [float(b) for b in lr.coefficients.toArray()]
    scaled = [(F.col(f) - moments[f][0]) / moments[f][1] for f in features]
    margin = F.lit(float(lr.intercept))
    for b, z in zip(beta, scaled):
        margin = margin + b * z
    residual = F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col(label))
    total = F.sum("weight")
    cells = [F.struct(F.lit(f).alias("feature"),
                      (F.sum(residual * z) / total + b / n).alias("gradient"))
             for f, b, z in zip(features, beta, scaled)]
    cells.append(F.struct(F.lit("(intercept)").alias("feature"), (F.sum(residual) / total).alias("gradient")))
    return grouped.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def fold_cube(folds: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
              label: str = LABEL_COLUMN, fold: str = "fold") -> DataFrame:
    """J-19 in one grouped table: (fold, features, label, n), written once. The training set
    of a fold is the sum over the other folds, so it needs no grouping of its own."""
    return materialize(folds.groupBy(fold, *features, label).agg(F.count(F.lit(1)).alias("n")))


def cube_statistics(cube: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
                    label: str = LABEL_COLUMN, fold: str = "fold") -> dict:
    """Per fold: class counts and (mean, population sd) per feature of its training set, all from one
    aggregate of at most folds x classes rows. Sums of whole numbers below 2**53 are exact."""
    x = {f: F.col(f).cast("double") for f in features}
    rows = (cube.groupBy(fold, label).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * x[f]).alias(f"s_{f}") for f in features],
        *[F.sum(F.col("n") * x[f] * x[f]).alias(f"q_{f}") for f in features])
        .limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{fold} and {label} have more than {MAX_CLASSES} combinations")
    out = {}
    for held in sorted({r[fold] for r in rows}):
        train = [r for r in rows if r[fold] != held]
        counts: dict = {}
        for r in train:
            counts[r[label]] = counts.get(r[label], 0) + r["n"]
        n = sum(counts.values())
        moments = {}
        for f in features:
            mean = sum(r[f"s_{f}"] for r in train) / n if n else 0.0
            square = sum(r[f"q_{f}"] for r in train) / n if n else 0.0
            moments[f] = (mean, max(0.0, square - mean * mean) ** 0.5)
        out[held] = (counts, moments)
    return out


def fit_logistic_fold(cube: DataFrame, held: int, counts: Mapping[int, int],
                      moments: Mapping[str, tuple[float, float]], label: str = LABEL_COLUMN,
                      fold: str = "fold") -> PipelineModel:
    """The balanced logistic regression of one fold's training set, from the cube."""
    train = balanced_weights(cube.filter(F.col(fold) != held), label, out="w1", counts=dict(counts))
    weighted = train.withColumn("weight", F.col("w1") * F.col("n")).drop("w1", "n").cache()
    try:
        return logistic_model(moments, label, n_train=sum(counts.values())).fit(weighted)
    finally:
        weighted.unpersist()


def split_bins(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> int:
    """Bins that keep every distinct value of every feature apart: the
    approximate number of distinct values (1 % error) with a margin of 5 %. Spark looks for the
    values in a sample of max_bins ** 2 rows, so bins are at least the root of the rows."""
    found = df.agg(F.greatest(*[F.approx_count_distinct(f, 0.01) for f in features],
                              F.lit(0)), F.count(F.lit(1))).first()
    return max(32, int(found[0] * 1.05) + 2, isqrt(found[1]) + 1)


def row_groups(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
               label: str = LABEL_COLUMN) -> DataFrame:
    """(features, label, n): rows of equal features and label as one row."""
    return df.groupBy(*features, label).agg(F.count(F.lit(1)).alias("n"))


def with_draws(groups: DataFrame, trees: int, seed: int = RANDOM_STATE) -> DataFrame:
    """Row groups with ``draws``: how often each tree's bootstrap holds the group. A row is drawn
    Poisson(1) times, as in Spark's forest, so ``n`` equal rows are drawn Poisson(n)
    times. A group's draws depend on its values and the seed alone, not on where it lies."""
    import numpy as np
    import pyarrow as pa

    values = [c for c in groups.columns if c != "n"]

    def draw(batches):
        for batch in batches:
            keys, counts = batch.column("__key").to_pylist(), batch.column("n").to_pylist()
            drawn = [np.random.Generator(np.random.Philox(key=[k % 2**64, seed])).poisson(n, trees)
                     for k, n in zip(keys, counts)]
            flat = np.concatenate(drawn) if drawn else np.empty(0, "int64")
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, trees, "int32"), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in values] + [lists], names=[*values, "draws"])

    schema = StructType([groups.schema[c] for c in values] + [StructField("draws", ArrayType(LongType()))])
    return groups.withColumn("__key", F.xxhash64(*values)).mapInArrow(draw, schema)


def fit_forest(train: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
               label: str = LABEL_COLUMN, trees: int = RF_TREES,
               max_depth: int = RF_MAX_DEPTH) -> PipelineModel:
    """J-6: balanced random forest, fitted on the groups of equal rows (``fit_forest_groups``)."""
    return fit_forest_groups(row_groups(train, features, label), features, label, trees, max_depth)


def fit_forest_groups(groups: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
                      label: str = LABEL_COLUMN, trees: int = RF_TREES,
                      max_depth: int = RF_MAX_DEPTH, seed: int = RANDOM_STATE,
                      in_driver: bool = True) -> PipelineModel | FO.GrownForest:
    """The forest of the rows that (features, label, n) stands for.

    Bootstrap draws are made per group (``with_draws``), so every pass is over the distinct
    rows, whatever their number of copies. Up to ``forest.GROUPS_IN_TASK`` groups, tasks grow whole
    trees (``forest.grown_trees``, one job); beyond, Spark's tree induction fits ``TREES_AT_ONCE`` trees
    beside each other. Both give the same trees. The layout follows the groups alone, so a
    fit does not depend on the number of cores.

    With ``in_driver`` false, trees that tasks have grown stay a written table, which
    ``score`` takes as well."""
    groups = materialize(groups)
    per_class = (groups.groupBy(label).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
                 .limit(MAX_CLASSES + 1).collect())
    if len(per_class) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    counts = {r[label]: r["n"] for r in per_class}
    if not counts or any(c is None or c < 0 or c != int(c) for c in counts):
        raise ValueError(f"{label} must hold classes numbered from 0, it has {sorted(counts, key=str)[:10]}")
    held = sum(r["groups"] for r in per_class)
    parts = max(1, -(-held // GROUPS_PER_TASK))
    keys = [*features, label]
    laid = groups.repartition(parts, *keys).sortWithinPartitions(*keys)
    drawn = balanced_weights(with_draws(laid, trees, seed), label, out="w1", counts=counts)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    seeds = [random.Random(seed * 1_000_003 + i).getrandbits(31) for i in range(trees)]
    if held <= FO.GROUPS_IN_TASK:
        like, classes = tree_model(label, "weight", max_depth, seeds[0], max(32, held)), int(max(counts)) + 1
        grown = FO.grown_forest(drawn, features, label, classes, seeds, max_depth, like)
        return PipelineModel(stages=[assembler, grown.model()]) if in_driver else grown
    bins = split_bins(groups, features)
    rows = assembler.transform(drawn).select("features", label, "w1", "draws").cache()

    def fit_tree(i: int):
        own = rows.withColumn("weight", F.get("draws", F.lit(i)) * F.col("w1")).filter("weight > 0")
        return tree_model(label, "weight", max_depth, seeds[i], bins).fit(own)

    try:
        with ThreadPoolExecutor(max_workers=TREES_AT_ONCE) as pool:
            fitted = list(pool.map(fit_tree, range(trees)))
    finally:
        rows.unpersist()
    return PipelineModel(stages=[assembler, join_forests(groups.sparkSession, fitted)])


def join_forests(spark: SparkSession,
                 forests: Sequence[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of several, in their order, with the columns of the first.
    The session is given: threads that fit have no active one."""
    models = spark._jvm.org.apache.spark.ml.classification
    found = [tree for forest in forests for tree in forest._java_obj.trees()]
    trees = spark.sparkContext._gateway.new_array(models.DecisionTreeClassificationModel, len(found))
    for i, tree in enumerate(found):
        trees[i] = tree
    first = forests[0]
    joined = models.RandomForestClassificationModel(first.uid, trees, first.numFeatures, first.numClasses)
    first._java_obj.copyValues(joined, spark._jvm.org.apache.spark.ml.param.ParamMap.empty())
    joined.set(joined.getParam("numTrees"), len(found))
    model = RandomForestClassificationModel(joined)
    model._transfer_params_from_java()
    return model


def score(model: PipelineModel | FO.GrownForest, df: DataFrame, id_col: str = "encounter_id",
          label: str = LABEL_COLUMN, rows: int | None = None) -> DataFrame:
    """J-7: (id, label, score) with score = probability of the positive class. ``rows`` says
    how many there are, if that is known: a forest's table goes to as few tasks as hold them."""
    if isinstance(model, FO.GrownForest):
        return FO.scores(model, df, id_col, label, None if rows is None else max(1, -(-rows // FO.ROWS_PER_TASK)))
    return model.transform(df).select(
        F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"),
        vector_to_array("probability")[1].alias("score"))


def coefficients(model: PipelineModel, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """J-13: logistic coefficients by feature, ascending."""
    lr = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [(f, float(c)) for f, c in zip(features, lr.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy("coefficient")


def importances(model: PipelineModel, features: Sequence[str] = FEATURE_COLUMNS,
                top: int | None = None) -> DataFrame:
    """J-14: forest importances by feature, largest first; ``top`` keeps the first rows."""
    rf = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, rf.featureImportances.toArray())]
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")
    return out.limit(top) if top is not None else out


def compare_models(scored_by_name: Mapping[str, DataFrame]) -> DataFrame:
    """J-12: ROC-AUC and average precision per model, plus a random baseline
    row (AUC 0.5, AP = positive rate)."""
    frames = []
    for name, scored in scored_by_name.items():
        # one scoring pass per model: AUC, AP and positive rate together
        frames.append(ranking_metrics(scored).select(
            F.lit(name).alias("model"), "roc_auc", "average_precision", "positive_rate"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    baseline = frames[0].select(F.lit("Baseline (random)").alias("model"),
                                F.lit(RANDOM_BASELINE_AUC).alias("roc_auc"),
                                F.col("positive_rate").alias("average_precision"),
                                "positive_rate")
    return out.unionByName(baseline).drop("positive_rate")


def with_best_flag(metrics: DataFrame, forest: str = "Random Forest",
                   logistic: str = "Logistic Regression") -> DataFrame:
    """J-15 as a column: ``best`` marks the model with the higher ROC-AUC
    among the two (the forest wins ties); the metrics table has 3 rows."""
    auc = {m: F.max(F.when(F.col("model") == m, F.col("roc_auc"))).over(Window.partitionBy())
           for m in (forest, logistic)}
    winner = F.when(auc[forest] >= auc[logistic], F.lit(forest)).otherwise(F.lit(logistic))
    return metrics.withColumn("best", F.col("model") == winner)


def best_model(metrics: DataFrame, forest: str = "Random Forest",
               logistic: str = "Logistic Regression") -> str:
    """J-15: the forest wins ties on ROC-AUC."""
    vals = {r["model"]: r["roc_auc"] for r in
            metrics.filter(F.col("model").isin(forest, logistic)).collect()}
    return forest if vals[forest] >= vals[logistic] else logistic


def evaluate_best(train: DataFrame, test: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
                  label: str = LABEL_COLUMN, id_col: str = "encounter_id",
                  threshold: float = 0.5) -> dict[str, DataFrame]:
    """Fit both models, compare them on ``test`` and evaluate the better one
    (J-12, J-15 .. J-18): returns ``comparison``, ``best_scored``,
    ``confusion``, ``sweep`` and ``report`` DataFrames."""
    scored = {"Logistic Regression": materialize(score(fit_logistic(train, features, label),
                                                       test, id_col, label)),
              "Random Forest": materialize(score(fit_forest(train, features, label),
                                                 test, id_col, label))}
    comparison = with_best_flag(compare_models(scored))
    best = scored[best_model(comparison)]
    return {"comparison": comparison, "best_scored": best,
            "confusion": confusion(best, threshold), "sweep": threshold_sweep(best),
            "report": classification_report(best, threshold)}


def cross_validate(frame: DataFrame, k: int = CV_FOLDS, features: Sequence[str] = FEATURE_COLUMNS,
                   label: str = LABEL_COLUMN, id_col: str = "encounter_id",
                   trees: int = RF_TREES, max_depth: int = RF_MAX_DEPTH,
                   parallelism: int = 4) -> DataFrame:
    """J-19: stratified k-fold ROC-AUC for both models, weights refit per fold.

    All fits read the cube of the fold-assigned frame (``fold_cube``), which is written once to the
    shared checkpoint folder. Held-out rows of equal features have one score: a model scores the
    fold's part of the cube, and the score counts as often as there are rows. Scores are
    written as soon as a model is there; a forest stays a table (``forest.GrownForest``).
    Up to ``parallelism`` fits are submitted at once (each fit is itself a
    series of distributed jobs), as Spark's CrossValidator does. All held-out scores are
    written and ranked together (``ranking_metrics_by_key``).
    Returns (model, fold, roc_auc).
    """
    rows = materialize(frame)
    parts = stratified_folds(rows.select(id_col, label), label, id_col, k).select(id_col, "fold")
    cube = fold_cube(rows.join(parts, id_col), features, label)
    statistics = cube_statistics(cube, features, label)
    held = {r["fold"]: r["count"] for r in cube.groupBy("fold").count().collect()}
    fitters = {"Random Forest": lambda f: fit_forest_groups(
                   cube.filter(F.col("fold") != f).groupBy(*features, label).agg(F.sum("n").alias("n")),
                   features, label, trees, max_depth, in_driver=False),
               "Logistic Regression": lambda f: fit_logistic_fold(cube, f, *statistics[f], label)}

    def run(task: tuple[str, int]) -> DataFrame:
        name, f = task
        # in place of an id, the number of rows that a row of the cube stands for
        return materialize(score(fitters[name](f), cube.filter(F.col("fold") == f), "n", label, held[f]).select(
            F.lit(name).alias("model"), F.lit(f).cast("int").alias("fold"), "label", "score", F.col("id").alias("n")))

    # the long fits first
    tasks = [(name, f) for name in fitters for f in statistics]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scored = list(pool.map(run, tasks))
    everything = scored[0]
    for s in scored[1:]:
        everything = everything.unionByName(s)
    return ranking_metrics_by_key(everything, ["model", "fold"], weight="n").select("model", "fold", "roc_auc")
