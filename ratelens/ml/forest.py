"""Trees of a forest grown whole inside tasks (J-6), equal to those of Spark's tree induction.

Spark fits a tree by one job a level, so a forest of deep trees is thousands of short jobs, and
the driver holds all of their state. Here the groups of equal rows go to the tasks once, packed,
and a task grows its trees from root to leaves; only finished nodes come out. The result is that of
``RandomForestClassifier`` with the same seed, node by node: bins are the values of the tree's
own rows, features of a node are drawn by the same generators in the same order, and sums are taken
in the order of the rows (tested against Spark).

A grown forest is a written table of packed trees. Scoring sends the trees to the rows, from task to
task, so a forest never passes the driver; ``GrownForest.model`` makes Spark's model of it, which does.

A task holds all groups of a fit, so this is for at most ``GROUPS_IN_TASK`` groups; ``fit_forest_groups``
gives more to Spark's own induction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialize, new_scratch

GROUPS_IN_TASK = 500_000  # groups of equal rows that a task holds: about 150 MB with 9 features
TREES_PER_TASK = 4
ROWS_PER_TASK = 50_000  # scored together; a task holds them while the trees pass
CELLS = 4_000_000  # of the histograms that are held at once
EPSILON = 2.220446049250313e-16  # impurity below which a child is a leaf
INVALID = -1.7976931348623157e308  # gain of a split that leaves a side empty

#: A packed tree: what a row is asked (feature, cut, no, stats by node), and what was measured there.
TREE_SCHEMA = "tree int, asks binary, measures binary"
NODE_SCHEMA = ("tree int, id int, prediction double, impurity double, stats array<double>, raw long, "
               "gain double, yes int, no int, feature int, cut double")

_MULTIPLIER, _INCREMENT, _LOW_48 = 0x5DEECE66D, 0xB, (1 << 48) - 1


@lru_cache(maxsize=1)
def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """State i + 1 of java.util.Random is ``a[i] * state + c[i]`` (mod 2**48); n is a power of 2."""
    a, c = np.array([_MULTIPLIER], np.uint64), np.array([_INCREMENT], np.uint64)
    while len(a) < n:
        a, c = np.concatenate([a, a * a[-1]]), np.concatenate([c, a * c[-1] + c])
    return a, c


class JavaRandom:
    """The longs of java.util.Random."""

    def __init__(self, seed: int):
        self.state = (seed ^ _MULTIPLIER) & _LOW_48

    def _states(self, n: int) -> np.ndarray:
        a, c = _steps(max(1024, 1 << (n - 1).bit_length()))
        return (a[:n] * np.uint64(self.state) + c[:n]) & np.uint64(_LOW_48)

    def peek(self, n: int) -> np.ndarray:
        """The next n longs; they stay the next ones."""
        half = (self._states(2 * n) >> np.uint64(16)).astype(np.uint32).view(np.int32).astype(np.int64)
        return (half[0::2] << 32) + half[1::2]

    def skip(self, n: int) -> None:
        self.state = int(self._states(2 * n)[-1])


def _murmur(words: Sequence[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """MurmurHash3 (32 bits) of 4-byte words."""
    def turned(x, bits):
        return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))

    h = seed
    for k in words:
        h = turned(h ^ (turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13)
        h = h * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4 * len(words))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def feature_subsets(seeds: np.ndarray, features: int, tried: int) -> np.ndarray:
    """``tried`` of the features for each seed: Spark's reservoir sample on its xorshift generator."""
    bits = seeds.astype(np.int64).view(np.uint64)
    words = [(bits >> np.uint64(32)).astype(np.uint32).byteswap(), bits.astype(np.uint32).byteswap()]
    low = _murmur(words, np.full(len(bits), 0x3C074A61, np.uint32))
    state = (_murmur(words, low).astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    kept = np.tile(np.arange(tried), (len(bits), 1))
    for item in range(tried, features):
        drawn = []
        for n in (26, 27):
            state = state ^ (state << np.uint64(21))
            state = state ^ (state >> np.uint64(35))
            state = state ^ (state << np.uint64(4))
            drawn.append(state & np.uint64((1 << n) - 1))
        share = ((drawn[0] << np.uint64(27)) + drawn[1]).astype(np.float64) * 2.0 ** -53
        place = (share * (item + 1)).astype(np.int64)
        into = place < tried
        kept[into, place[into]] = item
    return kept


def _total(stats: np.ndarray) -> np.ndarray:
    total = stats[..., 0]
    for c in range(1, stats.shape[-1]):
        total = total + stats[..., c]
    return total


def _gini(stats: np.ndarray) -> np.ndarray:
    """Impurity of class weights (last axis); 0 without weight."""
    total, impurity = _total(stats), np.ones(stats.shape[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(stats.shape[-1]):
            share = stats[..., c] / total
            impurity = impurity - share * share
    return np.where(total == 0, 0.0, impurity)


def grow_tree(values: Sequence[np.ndarray], labels: np.ndarray, weights: np.ndarray, classes: int,
              max_depth: int, seed: int, memory_mb: int) -> dict[str, np.ndarray]:
    """One tree on the rows of positive weight: its nodes, the root first, each before its ``yes`` subtree and
    that before its ``no`` subtree. Two leaves of one prediction are one leaf, as Spark prunes.

    Nodes wait on a stack; those within ``memory_mb`` (as Spark counts it) are split together, so
    that features are drawn in Spark's order.
    """
    own = weights > 0
    labels, weights = labels[own], weights[own]
    rows, n_features = len(labels), len(values)
    if not rows:
        raise ValueError("a tree without rows: none was drawn")
    cuts, codes = [], np.empty((n_features, rows), np.int32)
    for f, x in enumerate(values):
        x = x[own]
        found = np.unique(x)
        cuts.append((found[:-1] + found[1:]) / 2.0)
        codes[f] = np.searchsorted(cuts[f], x)
    bins = np.array([len(c) + 1 for c in cuts])
    tried = ceil(sqrt(n_features))

    most = 2 * rows + 1
    stats, raw = np.zeros((most, classes)), np.zeros(most, np.int64)
    impurity, gain, cut = np.zeros(most), np.full(most, -1.0), np.zeros(most)
    depth, feature = np.zeros(most, np.int16), np.full(most, -1, np.int32)
    yes, no = np.full(most, -1, np.int32), np.full(most, -1, np.int32)
    valid, place = np.ones(most, bool), np.empty(most, np.int64)
    stats[0], raw[0] = np.bincount(labels, weights, classes), rows
    impurity[0] = _gini(stats[0])
    made, stack, at, random = 1, np.zeros(1, np.int64), np.zeros(rows, np.int64), JavaRandom(seed)

    while len(stack):
        order = stack[::-1]
        tries = (feature_subsets(random.peek(len(order)), n_features, tried) if tried < n_features
                 else np.tile(np.arange(n_features), (len(order), 1)))
        room = np.cumsum(8 * classes * bins[tries].sum(1))
        taken = max(1, int(np.searchsorted(room, memory_mb << 20, "right")))
        random.skip(min(taken + 1, len(order)))  # the first that finds no room has drawn as well
        nodes, tries, stack = order[:taken], tries[:taken], stack[:len(stack) - taken]

        place[:made] = -1
        place[nodes] = np.arange(taken)
        here = place[at]
        best = np.full((taken, tries.shape[1]), -np.inf)
        split = np.zeros((taken, tries.shape[1]), np.int64)
        sides = np.zeros((taken, tries.shape[1], 2, classes))
        counts = np.zeros((taken, tries.shape[1], 2), np.int64)
        root_first = next((int(f) for f in tries[0] if bins[f] > 1), -1) if nodes[0] == 0 else -1
        for f in sorted(range(n_features), key=lambda f: f != root_first):
            asks, slot = np.nonzero(tries == f)  # each node once: its features are different
            step = max(1, CELLS // int(classes * bins[f]))
            for i in range(0, len(asks) if bins[f] > 1 else 0, step):
                some, some_slot = asks[i:i + step], slot[i:i + step]
                local = np.full(taken + 1, -1)  # the last is for rows that wait
                local[some] = np.arange(len(some))
                mine = local[here]
                in_some = np.nonzero(mine >= 0)[0]
                key = mine[in_some] * bins[f] + codes[f, in_some]
                cells = len(some) * bins[f]
                weighed = np.bincount(key * classes + labels[in_some], weights[in_some], cells * classes)
                weighed = np.cumsum(weighed.reshape(len(some), bins[f], classes), axis=1)
                counted = np.cumsum(np.bincount(key, minlength=cells).reshape(len(some), bins[f]), axis=1)
                left, left_n = weighed[:, :-1], counted[:, :-1]
                right, right_n = weighed[:, -1:] - left, counted[:, -1:] - left_n
                if f == root_first:
                    stats[0] = left[0, 0] + right[0, 0]
                    impurity[0] = _gini(stats[0])
                left_w, right_w = _total(left), _total(right)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = (impurity[nodes[some]][:, None] - left_w / (left_w + right_w) * _gini(left)
                             - right_w / (left_w + right_w) * _gini(right))
                    bad = (left_n < 1) | (right_n < 1) | (left_w < 0) | (right_w < 0) | (gains < 0)
                gains[bad] = INVALID
                found, every = gains.argmax(1), np.arange(len(some))
                best[some, some_slot], split[some, some_slot] = gains[every, found], found
                sides[some, some_slot, 0], sides[some, some_slot, 1] = left[every, found], right[every, found]
                counts[some, some_slot, 0] = left_n[every, found]
                counts[some, some_slot, 1] = right_n[every, found]

        chosen, every = best.argmax(1), np.arange(taken)
        top = best[every, chosen]
        valid[nodes] = top > INVALID
        if (mute := np.isneginf(top)).any():  # no feature with two values: the weights of its rows
            at_mute = np.nonzero((here >= 0) & mute[here])[0]
            sums = np.bincount(here[at_mute] * classes + labels[at_mute], weights[at_mute], taken * classes)
            stats[nodes[mute]] = sums.reshape(taken, classes)[mute]
            impurity[nodes[mute]] = _gini(stats[nodes[mute]])
        inner = np.nonzero((top > 0) & (depth[nodes] < max_depth))[0]
        parents, kept = nodes[inner], chosen[inner]
        children = made + np.arange(2 * len(inner)).reshape(-1, 2)
        made += 2 * len(inner)
        gain[parents], feature[parents] = top[inner], tries[inner, kept]
        yes[parents], no[parents] = children[:, 0], children[:, 1]
        for f in range(n_features):
            of = inner[feature[parents] == f]
            cut[nodes[of]] = cuts[f][split[of, chosen[of]]] if len(of) else 0.0
        stats[children], raw[children] = sides[inner, kept], counts[inner, kept]
        impurity[children] = _gini(stats[children])
        depth[children] = depth[parents][:, None] + 1
        open_child = (depth[children] < max_depth) & (np.abs(impurity[children]) >= EPSILON)
        stack = np.concatenate([stack, children[open_child]])

        goes_on = np.zeros(taken + 1, bool)  # the last is for rows that wait
        goes_on[inner] = True
        moves = np.nonzero((here >= 0) & goes_on[here])[0]
        node = at[moves]
        answer = codes[feature[node], moves] > split[here[moves], chosen[here[moves]]]
        at[moves] = np.where(answer, no[node], yes[node])
        waits = np.zeros(made, bool)
        waits[stack] = True
        live = waits[at]
        if not live.all():
            at, labels, weights, codes = at[live], labels[live], weights[live], codes[:, live]

    predicted, leaf = stats[:made].argmax(1), feature[:made] < 0
    impurity = np.where(valid, impurity, -1.0)
    levels = [np.nonzero(depth[:made] == d)[0] for d in range(int(depth[:made].max()) + 1)]
    size = np.ones(made, np.int64)
    for level in reversed(levels):
        asking = level[~leaf[level]]
        a, b = yes[asking], no[asking]
        alike = leaf[a] & leaf[b] & (predicted[a] == predicted[b])
        leaf[asking[alike]] = True
        rest = asking[~alike]
        size[rest] = 1 + size[yes[rest]] + size[no[rest]]
    number = np.full(made, -1, np.int32)  # what lies below a pruned node gets none
    number[0] = 0
    for level in levels:
        asking = level[~leaf[level] & (number[level] >= 0)]
        number[yes[asking]] = number[asking] + 1
        number[no[asking]] = number[asking] + 1 + size[yes[asking]]
    out = np.nonzero(number >= 0)[0]
    out = out[np.argsort(number[out])]
    end = leaf[out]
    return {"id": number[out], "prediction": predicted[out].astype(np.float64), "impurity": impurity[out],
            "stats": stats[out], "raw": raw[out], "gain": np.where(end, -1.0, gain[out]),
            "yes": np.where(end, -1, number[yes[out]]).astype(np.int32),
            "no": np.where(end, -1, number[no[out]]).astype(np.int32),
            "feature": np.where(end, -1, feature[out]).astype(np.int32), "cut": cut[out]}


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, "int32"), rows.ravel())


def _unlisted(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, width)


def _packed(drawn: DataFrame, features: Sequence[str], label: str, trees: int) -> DataFrame:
    """(task, part, rows): the rows of a partition as one block for each task, with
    the draws of that task's trees alone."""
    names = [f"f{i}" for i in range(len(features))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        for name, column in zip(features, names):
            if table[column].null_count or np.isnan(table[column].to_numpy()).any():
                raise ValueError(f"{name} has NULL or NaN: a tree cannot ask for it")
        draws = _unlisted(table["draws"], trees)
        kind = np.uint16 if draws.max() < 1 << 16 else np.int64
        part = table["part"][0].as_py()
        fixed = table.select([*names, "label", "w1"])
        for task in range(-(-trees // TREES_PER_TASK)):
            own = np.ascontiguousarray(draws[:, task * TREES_PER_TASK:(task + 1) * TREES_PER_TASK].T, kind)
            block = fixed
            for i, d in enumerate(own):
                block = block.append_column(f"d{i}", pa.array(d))
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "part": pa.array([part], pa.int32()),
                                              "rows": pa.array([_to_bytes(block)], pa.binary())})

    plain = drawn.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names)],
                         F.col(label).cast("int").alias("label"), "w1", "draws",
                         F.spark_partition_id().alias("part"))
    return plain.mapInArrow(pack, "task int, part int, rows binary")


def grown_trees(drawn: DataFrame, features: Sequence[str], label: str, classes: int,
                seeds: Sequence[int], max_depth: int, memory_mb: int) -> DataFrame:
    """A packed tree (``TREE_SCHEMA``) for each seed, on rows with their weight ``w1`` and
    their ``draws`` for each tree. Rows are in the order of the partitions and of the rows in them."""
    n_features, seeds = len(features), list(seeds)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            for task, part, rows in zip(*(batch.column(c).to_pylist() for c in ("task", "part", "rows"))):
                blocks.setdefault(task, []).append((part, rows))
        while blocks:
            task, own = blocks.popitem()
            own.sort(key=lambda b: b[0])
            table = pa.concat_tables([_from_bytes(rows) for _, rows in own],
                                     promote_options="permissive").combine_chunks()
            values = [table[f"f{i}"].to_numpy() for i in range(n_features)]
            labels, w1 = table["label"].to_numpy().astype(np.int64), table["w1"].to_numpy()
            first = task * TREES_PER_TASK
            for i, seed in enumerate(seeds[first:first + TREES_PER_TASK]):
                weights = table[f"d{i}"].to_numpy().astype(np.float64) * w1
                found = grow_tree(values, labels, weights, classes, max_depth, seed, memory_mb)
                found["stats"] = _lists(found["stats"])
                asks, measures = (_to_bytes(pa.table({c: found[c] for c in some})) for some in (
                    ("feature", "cut", "no", "stats"), ("id", "prediction", "impurity", "raw", "gain", "yes")))
                yield pa.RecordBatch.from_pydict({"tree": pa.array([first + i], pa.int32()),
                                                  "asks": pa.array([asks], pa.binary()),
                                                  "measures": pa.array([measures], pa.binary())})

    tasks = -(-len(seeds) // TREES_PER_TASK)
    return (_packed(drawn, features, label, len(seeds)).repartitionById(tasks, F.col("task"))
            .mapInArrow(grow, TREE_SCHEMA))


@dataclass(frozen=True)
class GrownForest:
    """A written table of trees (``TREE_SCHEMA``) with what Spark's model of it needs: an estimator
    with its parameters, the number of trees, the columns of the features, the number of classes."""

    packed: DataFrame
    like: RandomForestClassifier
    trees: int
    features: tuple[str, ...]
    classes: int

    def nodes(self) -> DataFrame:
        """The trees as a node table (``NODE_SCHEMA``)."""
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, *parts in zip(*(batch.column(c).to_pylist() for c in ("tree", "asks", "measures"))):
                    asks, measures = map(_from_bytes, parts)
                    columns = {c: t[c] for t in (asks, measures) for c in t.column_names}
                    columns["tree"] = pa.array(np.full(len(asks), tree, np.int32))
                    yield from pa.table({c: columns[c] for c in names}).to_batches()

        return self.packed.mapInArrow(unpack, NODE_SCHEMA)

    def model(self) -> RandomForestClassificationModel:
        """Spark's model: a forest of single leaves is saved, its nodes are replaced, and Spark
        reads it back (a tree is put together in a task)."""
        spark = self.packed.sparkSession
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        ml, size = jvm.org.apache.spark.ml, len(self.features)
        empty = gateway.new_array(gateway.jvm.double, self.classes)
        leaf = ml.tree.LeafNode(0.0, 0.0, jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator(empty, 0))
        stubs = gateway.new_array(ml.classification.DecisionTreeClassificationModel, self.trees)
        for i in range(self.trees):
            stubs[i] = ml.classification.DecisionTreeClassificationModel(
                f"dtc_{uuid.uuid4().hex[:12]}", leaf, size, self.classes)
        self.like._transfer_params_to_java()
        stub = ml.classification.RandomForestClassificationModel(self.like.uid, stubs, size, self.classes)
        self.like._java_obj.copyValues(stub, ml.param.ParamMap.empty())
        stub.set(stub.getParam("numTrees"), self.trees)
        path = new_scratch(spark, "forest")
        stub.write().session(spark._jsparkSession).save(path)
        saved = spark.read.parquet(path + "/data").schema
        split = F.struct(F.col("feature").alias("featureIndex"),
                         F.when(F.col("feature") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>"))
                         .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        data = F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"),
                        F.col("raw").alias("rawCount"), "gain", F.col("yes").alias("leftChild"),
                        F.col("no").alias("rightChild"), split.alias("split"))
        values = {"treeID": F.col("tree"), "nodeData": data}
        (self.nodes().select(*[values[f.name].cast(f.dataType).alias(f.name) for f in saved])
         .write.mode("overwrite").parquet(path + "/data"))
        model = RandomForestClassificationModel.read().session(spark).load(path)
        delete_path(spark, path)
        return model


def grown_forest(drawn: DataFrame, features: Sequence[str], label: str, classes: int, seeds: Sequence[int],
                 max_depth: int, like: RandomForestClassifier) -> GrownForest:
    """The forest of a tree for each seed (``grown_trees``), written once."""
    packed = materialize(grown_trees(drawn, features, label, classes, seeds, max_depth, like.getMaxMemoryInMB()))
    return GrownForest(packed, like, len(seeds), tuple(features), classes)


def _vote(votes: np.ndarray, x: np.ndarray, asks: pa.Table) -> None:
    """Add a tree's votes to ``votes`` (rows x classes); x: features x rows. The child ``yes`` of a node is the next."""
    feature, cut, no = (asks[c].to_numpy() for c in ("feature", "cut", "no"))
    stats = _unlisted(asks["stats"], votes.shape[1])
    total = _total(stats)[:, None]
    shares = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    node = np.zeros(x.shape[1], np.int64)
    going = np.arange(x.shape[1]) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(going):
        at = node[going]
        at = np.where(x[feature[at], going] <= cut[at], at + 1, no[at])
        node[going] = at
        going = going[feature[at] >= 0]
    votes += shares[node]


def scores(forest: GrownForest, df: DataFrame, id_col: str, label: str, tasks: int | None = None) -> DataFrame:
    """(id, label, score) as of Spark's model, to the last bit: a tree votes with the shares of the classes
    in the leaf, votes are added in the order of the trees and divided by their sum.

    The rows are dealt over ``tasks`` (by default the session's number of shuffle partitions) and every
    tree goes to each task, after its rows. A task holds its rows and one tree."""
    names, classes = [f"f{i}" for i in range(len(forest.features))], forest.classes
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = df.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"),
                      *[F.col(f).cast("double").alias(n) for f, n in zip(forest.features, names)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(b for b in batches if b.num_rows):
            if any(batch.column(n).null_count or np.isnan(batch.column(n).to_numpy(zero_copy_only=False)).any()
                   for n in names):
                raise ValueError("a feature is NULL or NaN: a tree cannot ask for it")
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "tree": pa.array([-1], pa.int32()),
                                              "data": pa.array([_to_bytes(pa.Table.from_batches([batch]))], pa.binary())})

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, x, votes = [], None, None
        for batch in batches:
            for tree, data in zip(batch.column("tree").to_pylist(), batch.column("data").to_pylist()):
                if tree < 0:
                    rows.append(_from_bytes(data))
                    continue
                if not rows:
                    return
                if votes is None:
                    rows = [pa.concat_tables(rows).combine_chunks()]
                    x = np.array([rows[0][n].to_numpy() for n in names])
                    votes = np.zeros((x.shape[1], classes))
                _vote(votes, x, _from_bytes(data))
        if votes is None:
            return
        whole = _total(votes)
        share = np.divide(votes, whole[:, None], out=votes.copy(), where=whole[:, None] != 0)
        yield from rows[0].select(["id", "label"]).append_column("score", pa.array(share[:, 1])).to_batches()

    blocks = plain.mapInArrow(pack, "at int, tree int, data binary").select(
        (F.col("at") + F.spark_partition_id()).alias("task"), "tree", "data")
    trees = forest.packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "tree",
                                 F.col("asks").alias("data"))
    together = blocks.unionByName(trees).repartitionById(tasks, F.pmod("task", F.lit(tasks)))
    kind = plain.schema["id"].dataType.simpleString()
    return together.sortWithinPartitions("tree").mapInArrow(vote, f"id {kind}, label int, score double")
