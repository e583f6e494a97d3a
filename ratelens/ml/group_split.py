"""Split and folds that keep groups (patients) whole and classes at their quotas (J-2, J-19).

Groups of equal class counts are one type; they can stand for each other, so a
type with m groups gives each part its share of m, exactly but for a fraction of
one group. What is left, one fractional group per type, is rounded so that the
classes come out right: with c classes, as soon as c + 1 types are fractional
there is a way to move them that changes no class, and it is followed until one
of them is whole. At most c remain fractional and are rounded, so each
class of a part is off its quota by at most c groups' rows (``deviation_bound``).

Only types are handled one by one (never groups or rows): they stream through the driver, largest first, which
holds c + 1 of them and the rounded-up types. Groups are then placed by seeded
hash order within their type (``assign_parts``), and rows take the part of their group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CV_FOLDS, RANDOM_STATE, TEST_FRACTION
from ..operators.skew import skew_join
from ..session import materialize
from .split import MAX_CLASSES, assign_parts

MAX_TYPES = 1_000_000  # different vectors of class counts; more raise


def round_types(vectors, fractions) -> list[int]:
    """Which types round up (1) or down (0): ``vectors`` are class counts of one group of
    each type, ``fractions`` what is left of their quotas. Streaming; the sum of
    every class moves by at most the counts of as many types as there are classes."""
    out: list[int] = []
    open_: list[list] = []  # [place, vector, fraction]
    for vector, x in zip(vectors, fractions):
        out.append(0)
        if x <= 1e-12:
            continue
        if x >= 1 - 1e-12:
            out[-1] = 1
            continue
        open_.append([len(out) - 1, np.asarray(vector, float), float(x)])
        if len(open_) <= len(open_[0][1]):
            continue
        # a direction in which no class changes, followed to the nearest border
        z = np.linalg.svd(np.array([v for _, v, _ in open_]).T)[2][-1]
        here = np.array([f for _, _, f in open_])
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(z > 1e-12, (1 - here) / z, np.where(z < -1e-12, -here / z, np.inf))
        step = reach.min()
        here = here + step * z
        here[int(reach.argmin())] = round(here[int(reach.argmin())])
        rest = []
        for (place, v, _), f in zip(open_, here):
            if f <= 1e-9 or f >= 1 - 1e-9:
                out[place] = int(f > 0.5)
            else:
                rest.append([place, v, f])
        open_ = rest
    for place, _, f in open_:
        out[place] = int(f >= 0.5)
    return out


def _groups(df: DataFrame, label: str, group_col: str) -> tuple[DataFrame, list]:
    classes = [r[0] for r in df.select(label).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    classes.sort(key=lambda c: (c is not None, c))
    counts = [F.count_if(F.col(label).eqNullSafe(F.lit(c))) for c in classes]
    groups = df.groupBy(F.col(group_col).alias("__group")).agg(F.array(*counts).alias("__counts"))
    return materialize(groups.withColumn("__type", F.concat_ws(",", F.col("__counts").cast("array<string>")))), classes


def assign_groups(df: DataFrame, label: str, group_col: str, shares: list[float],
                  seed: int = RANDOM_STATE, out: str = "part", rows_per_task: int | None = None) -> DataFrame:
    """Add ``out``, the part of each row (0 .. len(shares)); part i has ``shares[i]`` of every class, the
    last one the rest, and every group lies in one part. NULL groups are one group, NULL labels a class."""
    groups, classes = _groups(df, label, group_col)
    types = materialize(groups.groupBy("__type").agg(F.first("__counts").alias("__counts"),
                                                     F.count(F.lit(1)).alias("m")))
    if types.count() > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} different class counts of groups; split by larger bins of {group_col}")
    ordered = types.orderBy(F.aggregate("__counts", F.lit(0).cast("long"), lambda a, c: a + c).desc(), "__type")
    names, vectors, left = [], [], []
    for r in ordered.toLocalIterator():
        names.append(r["__type"])
        vectors.append(r["__counts"])
        left.append(r["m"])
    left = np.array(left, np.int64)
    total, cuts, remaining = np.zeros(len(left), np.int64), [], 1.0
    for share in shares:
        quota = left * (share / remaining)
        whole = np.floor(quota + 1e-12).astype(np.int64)
        up = np.array(round_types(vectors, np.maximum(0.0, quota - whole)), np.int64)
        taken = np.minimum(left, whole + up)
        total, left, remaining = total + taken, left - taken, remaining - share
        cuts.append(total)
    quotas = df.sparkSession.createDataFrame(
        [(n, [int(c[i]) for c in cuts]) for i, n in enumerate(names)], "__type string, __quota array<long>")
    placed = assign_parts(groups.select("__group", "__type"), "__type", "__group", shares, seed, out,
                          quotas=materialize(quotas))
    parts = placed.select(F.col("__group").alias("__g"), out)
    keyed = df.withColumn("__g", F.col(group_col))
    spread = df.columns[0]
    more = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    known = skew_join(keyed.where(F.col("__g").isNotNull()), parts, "__g", spread, **more)
    alone = parts.where("__g IS NULL").select(F.col(out).alias("__o"))
    # at most one row: the part of the rows without a group
    nowhere = keyed.where("__g IS NULL").join(F.broadcast(alone.withColumn("__n", F.lit(True))),
                                              F.col("__g").isNull() == F.col("__n")).withColumn(out, F.col("__o"))
    return known.select(*df.columns, out).unionByName(nowhere.select(*df.columns, out))


def group_split(df: DataFrame, label: str, group_col: str, test_fraction: float = TEST_FRACTION,
                seed: int = RANDOM_STATE) -> DataFrame:
    """J-2 with whole groups: ``is_test`` = 1 for ``test_fraction`` of every class, within ``deviation_bound``."""
    parts = assign_groups(df, label, group_col, [test_fraction], seed, "__part")
    return parts.withColumn("is_test", (F.col("__part") == 0).cast("int")).drop("__part")


def group_folds(df: DataFrame, label: str, group_col: str, k: int = CV_FOLDS,
                seed: int = RANDOM_STATE) -> DataFrame:
    """J-19 with whole groups: ``fold`` in 0 .. k-1."""
    return assign_groups(df, label, group_col, [1 / k] * (k - 1), seed, "fold")


def deviation_bound(df: DataFrame, label: str, group_col: str) -> DataFrame:
    """(``label``, bound): the most by which a part's rows of a class may miss their quota. For c
    classes that are c times the rows of the group that holds most of the class; twice that in folds, as
    a later fold shares what earlier ones missed, and twice that is returned."""
    classes = df.select(label).distinct().count()
    per_group = df.groupBy(label, group_col).agg(F.count(F.lit(1)).alias("n"))
    return per_group.groupBy(label).agg((2 * classes * F.max("n")).alias("bound"))
