"""Exact stratified split and stratified folds (J-2, J-19).

Each row gets a seeded hash ``h`` of its id; within each class, rows are
ordered by ``(h, id)`` and cut at exact per-class quotas (test = first
``round(fraction * n_class)`` rows; fold boundaries at ``round(n_class * i / k)``).

No window spans a whole class (that would be one task per class). Rows are
put into ``2**bits`` ordered hash bins; a small table of per-(class, bin)
counts (at most classes x bins rows) gives each bin's first position in its
class. A bin that lies inside one part is assigned without ranking; only
the few bins that straddle a cut are ranked, with a window partitioned by
(class, bin). The assignment is a pure function of the data and the seed,
so a recomputed task after an executor loss gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CV_FOLDS, RANDOM_STATE, TEST_FRACTION


def _cut_positions(n: Column, fractions: list[float]) -> Column:
    return F.array(*[F.round(n * F.lit(f)).cast("long") for f in fractions])


HASH_BITS = 60


def portable_hash(value: Column, seed: int) -> Column:
    """The first 60 bits of md5("seed:value") as a non-negative long; any SQL
    engine can compute it, so a split can be checked row by row elsewhere."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
                   .cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


MAX_CLASSES = 64  # of a broadcast bin table


def assign_parts(df: DataFrame, label: str, id_col: str, fractions: list[float],
                 seed: int = RANDOM_STATE, out: str = "part", bits: int = 16,
                 quotas: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = index of the part (0 .. len(fractions)) of each row.

    ``fractions`` are cumulative cut points in (0, 1), e.g. ``[0.2]`` for a
    20 % first part, or ``[0.2, 0.4, 0.6, 0.8]`` for five folds.

    ``quotas`` (label, ``__quota``: an array of positions) replaces the rounded cut
    points of every class, for callers that have rounded them otherwise.

    The input is read three times (bin counts, whole bins, straddling bins);
    pass a written or checkpointed frame (``session.materialize``) when it is
    expensive to recompute.
    """
    keyed = df.withColumn("__h", portable_hash(F.col(id_col), seed))
    keyed = keyed.withColumn("__bin", F.shiftright("__h", HASH_BITS - bits).cast("int"))
    counts = keyed.groupBy(label, "__bin").agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.partitionBy(label).orderBy("__bin").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    table = counts.withColumn("__start", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))
    if quotas is None:
        table = table.withColumn("__cuts", _cut_positions(F.sum("__cnt").over(whole), fractions))
    else:
        table = table.join(quotas.withColumnRenamed("__quota", "__cuts"), label)
    first_part = F.size(F.filter("__cuts", lambda c: c <= F.col("__start")))
    last_part = F.size(F.filter("__cuts", lambda c: c <= F.col("__start") + F.col("__cnt") - 1))
    table = table.select(F.col(label).alias("__label"), F.col("__bin").alias("__tbin"),
                         "__start", "__cuts", first_part.alias("__p0"), last_part.alias("__p1"))
    # At most (number of classes) x 2**bits rows (about 131k for two classes
    # and 16 bits, a few MB): broadcast when the classes are few. Straddling bins hold about
    # n_class / 2**bits rows each, the only rows that are ranked.
    # null-safe on the label, so rows whose class is NULL form their own class
    # instead of being dropped by the join
    few = df.select(label).distinct().limit(MAX_CLASSES + 1).count() <= MAX_CLASSES
    joined = keyed.join(F.broadcast(table) if few else table,
                        F.col(label).eqNullSafe(F.col("__label"))
                        & (F.col("__bin") == F.col("__tbin")))
    inside = (joined.filter(F.col("__p0") == F.col("__p1"))
              .withColumn(out, F.col("__p0")))
    rank = Window.partitionBy(label, "__bin").orderBy("__h", id_col)
    pos = F.col("__start") + F.row_number().over(rank) - 1
    straddle = (joined.filter(F.col("__p0") != F.col("__p1"))
                .withColumn("__pos", pos)
                .withColumn(out, F.size(F.filter("__cuts", lambda c: c <= F.col("__pos")))))
    cols = df.columns + [out]
    return inside.select(*cols).unionByName(straddle.select(*cols))


def stratified_split(df: DataFrame, label: str, id_col: str,
                     test_fraction: float = TEST_FRACTION,
                     seed: int = RANDOM_STATE, group_col: str | None = None) -> DataFrame:
    """J-2: add ``is_test`` (0/1) with exactly round(test_fraction * n) test
    rows in each class.

    ``group_col`` (e.g. ``patient_nbr``) keeps every group in one part, so no
    patient is in both train and test. Then the split is by a seeded hash of
    the group (no shuffle at all) and the test share is close to, not
    exactly, ``test_fraction``; class proportions are not forced. ``group_split`` keeps
    groups whole and classes at their quotas.
    """
    if group_col is not None:
        u = F.pmod(F.xxhash64(F.col(group_col), F.lit(seed)), F.lit(1_000_000))
        return df.withColumn("is_test", (u < int(round(test_fraction * 1_000_000))).cast("int"))
    parts = assign_parts(df, label, id_col, [test_fraction], seed, "__part")
    return parts.withColumn("is_test", (F.col("__part") == 0).cast("int")).drop("__part")


def approximate_split(df: DataFrame, label: str, id_col: str,
                      fractions: dict | float = TEST_FRACTION, seed: int = RANDOM_STATE) -> DataFrame:
    """J-2 in one pass: ``is_test`` = 1 with the fraction of the row's class (one number, or class ->
    fraction; a class that is not named has 0), decided per row by a hash of its id.

    No shuffle and no second read, and rows of one id agree. The number of test rows of a class with n rows is
    binomial: within ``5 sqrt(n f (1 - f))`` of ``n f`` but for one draw in a million (``sampling_bound``).
    """
    if not isinstance(fractions, dict):
        share = F.lit(float(fractions))
    else:
        share = F.lit(0.0)
        for cls, f in fractions.items():
            share = F.when(F.col(label).eqNullSafe(F.lit(cls)), F.lit(float(f))).otherwise(share)
    cut = (share * F.lit(float(1 << HASH_BITS))).cast("long")
    return df.withColumn("is_test", (portable_hash(F.col(id_col), seed) < cut).cast("int"))


def sampling_bound(n: Column, fraction: float) -> Column:
    """Five standard deviations of the number of rows drawn from ``n``."""
    return 5.0 * F.sqrt(n * F.lit(fraction * (1 - fraction)))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = CV_FOLDS,
                     seed: int = RANDOM_STATE) -> DataFrame:
    """J-19: add ``fold`` in 0 .. k-1, class proportions kept in every fold."""
    return assign_parts(df, label, id_col, [i / k for i in range(1, k)], seed, "fold")


def split_summary(df: DataFrame, label: str, part: str = "is_test") -> DataFrame:
    """Rows per part and class."""
    return (df.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(part, label))


def part_rates(df: DataFrame, label: str, part: str = "is_test") -> DataFrame:
    """J-2 report: rows and positive rate per part."""
    return (df.groupBy(part).agg(F.count(F.lit(1)).alias("n"),
                                 F.avg(label).alias("positive_rate")).orderBy(part))
