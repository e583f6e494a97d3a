"""Evaluation of a scored frame ``(id, label, score)`` (J-8 .. J-11, J-16 .. J-18, J-20).

Ranking metrics need cumulative sums over scores in descending order. A
window ordered over all rows would run in a single task, so instead:

1. rows are reduced to one row per distinct score with (tp, fp) counts;
2. distinct scores are cut into ordered bins at approximate quantiles
   (a bounded list of cut points on the driver, ``n_bins`` at most);
3. bin totals (at most ``n_bins + 1`` rows) are cumulated with a small
   window and broadcast back as offsets;
4. a window partitioned by bin adds the running sum within each bin.

Equal scores always fall in the same bin, so ties are handled exactly. The
formulas below use the tie-aware trapezoid for ROC-AUC and the step sum
for average precision.

Ratios whose denominator is 0 (a class that is absent) are NULL.

Rows with a NULL label or a NULL or NaN score cannot be ranked or counted as either
class; every operator here excludes them explicitly (``_rankable``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CLASS_NAMES, DEFAULT_THRESHOLD, SWEEP_COUNT, SWEEP_START,
                         SWEEP_STEP)



def _rankable(scored: DataFrame, label: str, score: str) -> DataFrame:
    return scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull()
                         & ~F.isnan(F.col(score).cast("double")))


def score_groups(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score: (score, tp, fp)."""
    return (_rankable(scored, label, score).groupBy(F.col(score).alias("score"))
            .agg(F.sum(F.col(label).cast("long")).alias("tp"),
                 F.count(F.lit(1)).alias("__n"))
            .withColumn("fp", F.col("__n") - F.col("tp")).drop("__n"))


def default_bins(spark) -> int:
    """Bins for the ranking windows: a few per shuffle partition, so the
    per-bin windows spread over the cluster whatever its size."""
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def cumulative_by_score(groups: DataFrame, n_bins: int | None = None,
                        cuts_from: DataFrame | None = None) -> DataFrame:
    """Add inclusive cumulative ``ctp``/``cfp`` in descending score order, and
    the totals ``P`` (positives) and ``N`` (negatives) on every row.

    ``cuts_from`` is the frame the quantile cut points are taken from (any
    frame with a ``score`` column; the row-level scores need no shuffle).
    """
    n_bins = n_bins or default_bins(groups.sparkSession)
    probs = [i / n_bins for i in range(1, n_bins)]
    src = groups if cuts_from is None else cuts_from
    cuts = sorted(set(src.approxQuantile("score", probs, 1.0 / (4 * n_bins))))
    if cuts:
        splits = [float("-inf")] + cuts + [float("inf")]
        binned = Bucketizer(splits=splits, inputCol="score", outputCol="bin",
                            handleInvalid="keep").transform(groups)
    else:
        binned = groups.withColumn("bin", F.lit(0.0))
    totals = binned.groupBy("bin").agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # Windows over the bin totals only: at most n_bins + 1 rows.
    offsets = totals.select(
        "bin",
        F.coalesce(F.sum("btp").over(above), F.lit(0)).alias("otp"),
        F.coalesce(F.sum("bfp").over(above), F.lit(0)).alias("ofp"),
        F.sum("btp").over(everything).alias("P"),
        F.sum("bfp").over(everything).alias("N"))
    # offsets has at most n_bins + 1 rows by construction: safe to broadcast.
    run = (Window.partitionBy("bin").orderBy(F.col("score").desc())
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (binned.join(F.broadcast(offsets), "bin")
            .select("score", "tp", "fp",
                    (F.col("otp") + F.sum("tp").over(run)).alias("ctp"),
                    (F.col("ofp") + F.sum("fp").over(run)).alias("cfp"),
                    "P", "N"))


def _cumulative(scored: DataFrame, label: str, score: str, n_bins: int | None) -> DataFrame:
    """Distinct-score groups are computed once (one pass over the scored frame,
    which may be an expensive model transform) and written to the shared
    folder; cut points and running sums both read that small table."""
    from ..session import materialize
    return cumulative_by_score(materialize(score_groups(scored, label, score)), n_bins)


def _auc():
    return F.try_divide(
        F.sum(F.col("fp").cast("double") * (2 * F.col("ctp") - F.col("tp")).cast("double")),
        2.0 * F.max("P") * F.max("N"))


def _ap():
    return F.try_divide(F.sum(F.col("tp") * (F.col("ctp") / (F.col("ctp") + F.col("cfp")))),
                        F.max("P"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score",
            n_bins: int | None = None) -> DataFrame:
    """J-8: one-row ROC-AUC (ties count one half)."""
    cum = _cumulative(scored, label, score, n_bins)
    return cum.agg(_auc().alias("roc_auc"))


def average_precision(scored: DataFrame, label: str = "label", score: str = "score",
                      n_bins: int | None = None) -> DataFrame:
    """J-9: average precision, sum over thresholds of precision x recall step."""
    cum = _cumulative(scored, label, score, n_bins)
    return cum.agg(_ap().alias("average_precision"))


def ranking_metrics(scored: DataFrame, label: str = "label", score: str = "score",
                    n_bins: int | None = None) -> DataFrame:
    """J-8 + J-9 from one cumulative table: roc_auc, average_precision and
    positive_rate (the AP of a random ranking)."""
    cum = _cumulative(scored, label, score, n_bins)
    return cum.agg(_auc().alias("roc_auc"), _ap().alias("average_precision"),
                   F.try_divide(F.max("P"), F.max("P") + F.max("N")).alias("positive_rate"))


# --- many score lists at once -----------------------------------------------------------

FEW_KEYS = 1000  # score lists whose cuts and offsets are broadcast; more are joined by shuffle


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
    """Inner join on equal keys, NULL equal to NULL; ``right`` is broadcast when ``few``."""
    named = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        same = one if same is None else same & one
    return left.join(F.broadcast(named) if few else named, same).drop(*[f"__r_{c}" for c in on])


def cumulative_by_key(scored: DataFrame, keys: Sequence[str], label: str = "label",
                      score: str = "score", n_bins: int | None = None,
                      weight: str | None = None) -> DataFrame:
    """``cumulative_by_score`` of every score list of a frame: a list is the rows of equal
    ``keys`` (e.g. model and fold). One pass over the rows, one written table of
    distinct scores, one running sum, whatever the number of lists.

    ``weight`` names a column of whole numbers: the rows that a row stands for (1 without).

    Every list has its own cut points and bin offsets. Windows are over one list's bins
    (at most ``n_bins``) and over one bin of one list, so a list that holds
    most of the rows is spread like a single one.
    """
    from ..session import materialize
    keys = list(keys)
    n_bins = n_bins or default_bins(scored.sparkSession)
    times = F.lit(1) if weight is None else F.col(weight).cast("long")
    groups = materialize(
        _rankable(scored, label, score).groupBy(*keys, F.col(score).alias("score"))
        .agg(F.sum(F.col(label).cast("long") * times).alias("tp"), F.sum(times).alias("__n"))
        .select(*keys, "score", "tp", (F.col("__n") - F.col("tp")).alias("fp")))
    probs = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    cuts = materialize(groups.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("score", probs, F.lit(4 * n_bins))).alias("__cuts")))
    few = cuts.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    binned = _joined(groups, cuts, keys, few).withColumn(
        "bin", F.size(F.filter("__cuts", lambda c: c < F.col("score")))).drop("__cuts")
    totals = binned.groupBy(*keys, "bin").agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    whole = Window.partitionBy(*keys)
    above = whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "bin", F.coalesce(F.sum("btp").over(above), F.lit(0)).alias("otp"),
        F.coalesce(F.sum("bfp").over(above), F.lit(0)).alias("ofp"),
        F.sum("btp").over(whole).alias("P"), F.sum("bfp").over(whole).alias("N"))
    run = (Window.partitionBy(*keys, "bin").orderBy(F.col("score").desc())
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _joined(binned, offsets, [*keys, "bin"], few).select(
        *keys, "score", "tp", "fp", (F.col("otp") + F.sum("tp").over(run)).alias("ctp"),
        (F.col("ofp") + F.sum("fp").over(run)).alias("cfp"), "P", "N")


def ranking_metrics_by_key(scored: DataFrame, keys: Sequence[str], label: str = "label",
                           score: str = "score", n_bins: int | None = None,
                           weight: str | None = None) -> DataFrame:
    """J-8 + J-9 of every score list: keys, roc_auc, average_precision, positive_rate. With
    ``weight``, a row stands for so many rows."""
    return cumulative_by_key(scored, keys, label, score, n_bins, weight).groupBy(*keys).agg(
        _auc().alias("roc_auc"), _ap().alias("average_precision"),
        F.try_divide(F.max("P"), F.max("P") + F.max("N")).alias("positive_rate"))


def curves_by_key(scored: DataFrame, keys: Sequence[str], label: str = "label",
                  score: str = "score", n_bins: int | None = None) -> DataFrame:
    """J-10 + J-11 of every score list: keys, threshold, fpr, tpr, precision, recall at every
    distinct score, after the point of no prediction (NULL threshold)."""
    cum = cumulative_by_key(scored, keys, label, score, n_bins)
    points = cum.select(*keys, F.col("score").cast("double").alias("threshold"),
                        F.try_divide("cfp", "N").alias("fpr"), F.try_divide("ctp", "P").alias("tpr"),
                        (F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("precision"),
                        F.try_divide("ctp", "P").alias("recall"))
    start = (_rankable(scored, label, score).select(*keys).distinct()
             .select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                     F.lit(0.0).alias("tpr"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))
    return points.unionByName(start)


def _anchor(scored: DataFrame, **values: float) -> DataFrame:
    """One row with a NULL threshold and the given values."""
    return scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        *[F.lit(v).alias(name) for name, v in values.items()])


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score",
              n_bins: int | None = None) -> DataFrame:
    """J-10: (threshold, fpr, tpr) at every distinct score, after the start
    point (0, 0) whose threshold is NULL (above every score)."""
    cum = _cumulative(scored, label, score, n_bins)
    points = cum.select(F.col("score").cast("double").alias("threshold"),
                        F.try_divide("cfp", "N").alias("fpr"),
                        F.try_divide("ctp", "P").alias("tpr"))
    return (points.unionByName(_anchor(scored, fpr=0.0, tpr=0.0))
            .orderBy(F.col("threshold").desc_nulls_first()))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score",
             n_bins: int | None = None) -> DataFrame:
    """J-11: (threshold, precision, recall) at every distinct score, after the
    point of no prediction (precision 1, recall 0) whose threshold is NULL."""
    cum = _cumulative(scored, label, score, n_bins)
    points = cum.select(F.col("score").cast("double").alias("threshold"),
                        (F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("precision"),
                        F.try_divide("ctp", "P").alias("recall"))
    return (points.unionByName(_anchor(scored, precision=1.0, recall=0.0))
            .orderBy(F.col("threshold").desc_nulls_first()))


def _counts(scored: DataFrame, threshold: float, label: str, score: str) -> DataFrame:
    pred = F.col(score) >= threshold
    pos = F.col(label) == 1
    return _rankable(scored, label, score).agg(F.count_if(~pos & ~pred).alias("tn"),
                      F.count_if(~pos & pred).alias("fp"),
                      F.count_if(pos & ~pred).alias("fn"),
                      F.count_if(pos & pred).alias("tp"))


def confusion(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD,
              label: str = "label", score: str = "score") -> DataFrame:
    """J-16: confusion matrix at ``score >= threshold``; all four cells present."""
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                      F.col(c).alias("n"))
             for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return (_counts(scored, threshold, label, score)
            .select(F.inline(F.array(*cells))))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def sweep_grid(start: float = SWEEP_START, step: float = SWEEP_STEP,
               count: int = SWEEP_COUNT) -> list[float]:
    """Threshold grid, rounded to 2 decimals (no float drift)."""
    return [round(start + step * i, 2) for i in range(count)]


def threshold_sweep(scored: DataFrame, grid: Sequence[float] | None = None,
                    label: str = "label", score: str = "score") -> DataFrame:
    """J-17: precision, recall and F1 at each grid threshold (0 when undefined).

    One scan: each row gets the number of grid values at or below its score
    (its bucket), rows are counted per bucket (at most len(grid) + 1 rows),
    and counts are cumulated over those few rows.
    """
    grid = sorted(set(sweep_grid() if grid is None else grid))
    bucket = sum(F.when(F.col(score) >= g, 1).otherwise(0) for g in grid)
    per_bucket = (_rankable(scored, label, score).groupBy(bucket.alias("bucket"))
                  .agg(F.sum(F.col(label).cast("long")).alias("pos"),
                       F.count(F.lit(1)).alias("n")))
    spark = scored.sparkSession
    # Every bucket 0..len(grid) as rows (built JVM-side), so empty buckets count as zero.
    cells = [F.struct(F.lit(i).alias("bucket"),
                      F.lit(float(grid[i - 1]) if i > 0 else None).cast("double").alias("threshold"))
             for i in range(len(grid) + 1)]
    buckets = spark.range(1).select(F.inline(F.array(*cells)))
    # Both sides hold at most len(grid) + 1 rows.
    filled = (buckets.join(F.broadcast(per_bucket), "bucket", "left")
              .select("bucket", "threshold",
                      F.coalesce("pos", F.lit(0)).alias("pos"),
                      F.coalesce(F.col("n") - F.col("pos"), F.lit(0)).alias("neg")))
    down = Window.orderBy(F.col("bucket").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    at_or_above = (filled.select("bucket", "threshold",
                                 F.sum("pos").over(down).alias("tp"),
                                 F.sum("neg").over(down).alias("fp"),
                                 F.sum("pos").over(Window.partitionBy()).alias("P"))
                   .filter(F.col("bucket") > 0))
    p_all = F.col("P")
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), p_all)
    return (at_or_above
            .select("threshold", "tp", "fp", prec.alias("precision"), rec.alias("recall"))
            .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
            .orderBy("threshold"))


def classification_report(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                          label: str = "label", score: str = "score",
                          names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """J-18: precision, recall, F1 and support per class, accuracy, macro and
    weighted averages (0 where a ratio is undefined)."""
    c = _counts(scored, threshold, label, score)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    s0, s1 = tn + fp, tp + fn
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, s0)
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, s1)
    f0, f1 = _f1(p0, r0), _f1(p1, r1)
    total = s0 + s1
    null = F.lit(None).cast("double")

    def row(i, name, p, r, f, s):
        return F.struct(F.lit(i).alias("position"), F.lit(name).alias("class"),
                        p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.cast("long").alias("support"))
    rows = [row(0, names[0], p0, r0, f0, s0), row(1, names[1], p1, r1, f1, s1),
            row(2, "accuracy", null, null, _safe_div(tp + tn, total), total),
            row(3, "macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
            row(4, "weighted avg", _safe_div(p0 * s0 + p1 * s1, total),
                _safe_div(r0 * s0 + r1 * s1, total), _safe_div(f0 * s0 + f1 * s1, total), total)]
    return c.select(F.inline(F.array(*rows))).orderBy("position").drop("position")


def cv_summary(fold_scores: DataFrame, model: str = "model", fold: str = "fold",
               value: str = "roc_auc") -> DataFrame:
    """J-20: mean, population std and per-fold list of a CV metric per model."""
    return (fold_scores.groupBy(model)
            .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                 F.transform(F.array_sort(F.collect_list(F.struct(fold, value))),
                             lambda s: s[value]).alias("scores"))
            .orderBy(model))
