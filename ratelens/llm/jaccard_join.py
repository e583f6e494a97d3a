"""N-gram Jaccard join by chosen paths.

The set of a text is its distinct runs of ``words`` words (64-bit hashes).
Rows with the same set are one representative with a number of copies, so
copies never meet each other. Representatives are joined in three steps:

1. Chosen paths. In each run a set samples its tokens with probability
   ``1 / (least * size)`` under a hash that all sets share, so two sets
   with similarity ``least`` share at least one sampled token with
   probability 1 - 1/e or more. Sets that share one meet in a bucket. Small buckets are
   compared by brute force on one-permutation sketches (``loose`` is far
   below ``least``). A bucket above ``bucket`` members is compared with
   sampled pivots; what is like none of them is split, down to ``depth``: each
   bucket draws two places of the sketch by its own key, and every member goes
   on with what it has there, so no member is without a draw. What is still
   large at the last level is finished exactly by prefixes: with the tokens of
   these sets ordered from rare to frequent, two sets that reach ``least`` share one of their
   first ``n - least * n + 1``, so passages that many texts hold bring nobody together,
   and no bucket is cut. Runs repeat until a pair exactly at ``least`` that meets in large
   buckets down to the last level is found with probability ``recall``
   (``Settings.runs``: 7 for 0.997); pairs above ``least`` are found more often.
2. Components of the candidate links, by alternating large-star and
   small-star steps over written tables. A component so large that tiles would copy
   its sets more often than prefixes do is taken apart by prefixes, exactly: texts on one template
   are candidates of each other, but share no rare token.
3. Exact links. Within a component all sets meet once, in tiles of bounded
   size; the number of links per set (copies counted) and a spanning forest
   of the true links leave a tile, never its pairs. Components of that
   forest are the classes.

Joins on keys that may be hot (a bucket, a star's centre, a large group of
copies) are salted. Nothing about all documents passes through the driver;
intermediate tables are written to the shared checkpoint folder.

Words are lower-cased and split on white space; a text of fewer than ``words``
words is one token, a text without words has the empty set, is linked to
nothing and is a class of its own. Sets are verified on the upper 32 bits of the
hashes. Defined results: null text is empty; null ids are kept; repeated rows are copies of each other;
an empty table gives no rows; a class is named by the id of its first row;
extra columns are ignored (``drop_near_copies`` keeps them).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from .common import drop, release, resident, text_or_empty, written

BINS = 64
EMPTY = 65535
SALTS = 8
MARKS = 1 << 20
PLACE = 4096  # members of a bucket that meet its pivots in one place


@dataclass(frozen=True)
class Settings:
    words: int = 5
    least: float = 0.8
    loose: float = 0.6
    recall: float = 0.997  # of the pairs exactly at ``least``, at the deepest level
    depth: int = 4
    bucket: int = 128
    tile_members: int = 256
    tile_tokens: int = 1 << 21
    tiles: int = 8  # copies of a set, above which its component is taken apart by prefixes
    seed: int = 11

    @property
    def runs(self) -> int:
        """Runs that reach ``recall``. A pair at ``least`` meets at level 1 with
        probability 1 - 1/e; a split loses it when neither of the two drawn places
        agrees, or all that do are lost further down. Places agree less often
        than ``least`` by one deviation of a sketch."""
        agree = self.least - (self.least * (1 - self.least) / BINS) ** 0.5
        lost = 0.0
        for _ in range(self.depth - 1):
            lost = (1 - agree + agree * lost) ** 2
        return max(1, ceil(log(1 - self.recall) / log(1 - (1 - exp(-1)) * (1 - lost))))


# --- sets, sketches and paths -----------------------------------------------------

_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = h
        return h


def shingle_set(text: str, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = max(len(h) - words + 1, 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return np.unique(mixed(s))


def sketches(flat: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """One-permutation minhashes: per set and bin of the upper hash bits the
    least value, EMPTY where the bin has none. Each set's part of ``flat`` is sorted."""
    slot = doc * BINS + (flat >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    out = np.full(docs * BINS, EMPTY, np.uint16)
    out[slot[first]] = np.minimum((flat[first] >> np.uint64(42)) & np.uint64(0xFFFF), EMPTY - 1)
    return out.reshape(docs, BINS)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of all sketches of ``a`` with all of ``b``."""
    equal = (a[:, None] == b[None]).sum(axis=2)
    empty = ((a == EMPTY).astype(np.float32) @ (b == EMPTY).astype(np.float32).T)
    return (equal - empty) / np.maximum(BINS - empty, 1)


def sampled(flat: np.ndarray, doc: np.ndarray, sizes: np.ndarray, set_: Settings):
    """(set, run, token) of every sampled token."""
    share = np.minimum(1.0 / (set_.least * np.maximum(sizes, 1)), 1.0)
    limit = np.ceil(share * (1 << 32)).astype(np.uint64)[doc]
    found = []
    low = np.uint64(0xFFFFFFFF)
    for pair in range((set_.runs + 1) // 2):
        h = mixed(flat + np.uint64((set_.seed + pair) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for run, part in ((2 * pair, h & low), (2 * pair + 1, h >> np.uint64(32))):
            if run < set_.runs:
                at = np.flatnonzero(part < limit)
                found.append((doc[at], np.full(len(at), run), flat[at]))
    return [np.concatenate(x) for x in zip(*found)]


def split_keys(keys: np.ndarray, s: np.ndarray):
    """(member, key) in the next level's buckets. A bucket draws two places of
    the sketch by its key; an empty place stands for the next one that is not."""
    held = np.where(s != EMPTY, np.arange(BINS), 2 * BINS)
    after = np.concatenate([held, held + BINS], axis=1)
    after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1][:, :BINS] % BINS
    h = mixed(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    first = (h & np.uint64(0xFFFFFFFF)) % np.uint64(BINS)
    second = (first + np.uint64(1) + (h >> np.uint64(32)) % np.uint64(BINS - 1)) % np.uint64(BINS)
    who, out, seen = [], [], np.full(len(keys), -1)
    for place in (first, second):
        at = after[np.arange(len(keys)), place.astype(np.int64)]
        new = np.flatnonzero(at != seen)
        token = (place << np.uint64(32)) + (at.astype(np.uint64) << np.uint64(16)) \
            + s[np.arange(len(keys)), at]
        who.append(new)
        out.append(mixed(h ^ mixed(token + np.uint64(1)))[new].view(np.int64))
        seen = at
    return np.concatenate(who), np.concatenate(out)


def describe_sets(docs: DataFrame, id_col: str, text_col: str, set_: Settings) -> DataFrame:
    """(_row, _id, digest, n, sketch, paths, tokens) of every row; ``paths`` lists the
    sampled tokens by run, ``tokens`` holds the upper 32 bits of the set."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"),
                       F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    steps = set_.runs
    names = ["_row", "_id", "digest", "n", "sketch", "paths", "tokens"]

    def describe(batches):
        hashes = resident("word hashes", _WordHashes)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sets, size, first = [], 0, at
                while at < batch.num_rows and size < 500_000 and at - first < 1024:
                    sets.append(shingle_set(batch.column("_text")[at].as_py(), set_.words, hashes))
                    size += len(sets[-1])
                    at += 1
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), sizes)
                who, step, token = sampled(flat, doc, sizes, set_)
                slot = who * steps + step
                order = np.argsort(slot, kind="stable")
                ends = np.bincount(slot, minlength=len(sets) * steps).cumsum()
                inner = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()),
                    pa.array(token[order].view(np.int64)))
                paths = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1) * steps, pa.int32()), inner)
                part = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_id"),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                               for s in sets], pa.binary()),
                     pa.array(sizes, pa.int32()),
                     pa.array([s.tobytes() for s in sketches(flat, doc, len(sets))], pa.binary()),
                     paths,
                     pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets],
                              pa.binary())], names=names)

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"_row long, _id {kind}, digest binary, n int, sketch binary, "
                                     "paths array<array<bigint>>, tokens binary")


# --- helpers ----------------------------------------------------------------------

def salted_join(rows: DataFrame, keyed: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """Join with a table of one row a key; the rows of a hot key spread by ``by``."""
    spread = keyed.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
            .join(spread, [on, "_salt"], how).drop("_salt"))


def marked(rows: DataFrame, wanted: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``rows`` without most of those whose ``on`` is not in ``wanted``: rows that a join would move for
    nothing are dropped where they lie, by a table of at most MARKS hashes (that bound is
    what may be broadcast). With ``left_anti`` the others: rows that are surely not in ``wanted``."""
    mark = F.pmod(F.xxhash64(on), F.lit(MARKS))
    marks = wanted.select(mark.alias("_mark")).distinct()
    return rows.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", how).drop("_mark")


def buckets_of(members: DataFrame) -> DataFrame:
    """(key, size, least, same) of the buckets of two members or more; buckets of the same members agree in all but the key."""
    return members.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("least"),
                                      F.bit_xor(F.xxhash64("rep")).alias("same")).where("size > 1")


def small_buckets(sizes: DataFrame, bucket: int) -> DataFrame:
    """(key) of the buckets of at most ``bucket`` members; of buckets with the same members
    one, as comparing them again finds the same links."""
    return (sizes.where(F.col("size") <= bucket).groupBy("size", "least", "same")
            .agg(F.min("key").alias("key")).select("key"))


def runs_of(batches, key: str, columns: list[str]):
    """Lists of columns per run of equal keys, over batches sorted by the key."""
    held = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cols = [batch.column(c).to_pylist() for c in columns]
        if held is not None:
            keys = np.concatenate([held[0], keys])
            cols = [a + b for a, b in zip(held[1], cols)]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield [c[a:b] for c in cols]
        held = keys[edges[-1]:], [c[edges[-1]:] for c in cols]
    if held is not None and len(held[0]):
        yield held[1]


def roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each member's component in a symmetric adjacency matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for the nodes of the links (a, b); root is the least node.

    Ends when the links are stars: each node has its least neighbour only, or none that is less."""
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, path = written(both.distinct())
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = written(around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("around")))
        if least.where("m < a AND around > 1").isEmpty():
            break
        # large star: larger neighbours of a node go to its least neighbour, one link for each
        large, large_path = written(salted_join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")),
                                                least.select("a", "m"), "a", "b")
                                    .select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = salted_join(large, least, "a", "b")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        new, new_path = written(small)
        drop(edges, path, least_path, large_path)
        edges, path = new, new_path
    drop(edges, least_path)
    tree = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct()), path


# --- step 1: candidates -------------------------------------------------------------

def _brute_force(members: DataFrame, loose: float) -> DataFrame:
    """Links (a, b) inside buckets of bounded size: a star per group of alike sketches."""
    def compare(batches):
        a, b = [], []
        for reps, raw in runs_of(batches, "key", ["rep", "sketch"]):
            if len(reps) < 2:
                continue
            s = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, BINS)
            root = roots(alike(s, s) >= loose)
            for i in np.flatnonzero(root != np.arange(len(root))):
                a.append(reps[i])
                b.append(reps[root[i]])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(compare, "a long, b long"))


def _pivot_round(big: DataFrame, set_: Settings, want: int, turn: int, pick=None) -> DataFrame:
    """Each member of a large bucket against sampled pivots of the bucket (about ``want``,
    or the rows of ``pick``): (key, rep, a pivot or null, its sketch if it stays).

    A member leaves when it is ``loose`` alike a pivot. What is ``least`` alike
    that member is then at least loose - (1 - least) alike the same pivot
    (distances obey the triangle inequality), so every member is linked to all
    pivots down to there and two deviations of a sketch: both ends
    of a pair have a common pivot, or go on together. Pivots that are linked
    count as one, so a member has one link for each group of them.

    A bucket lies in as many places as its size asks for. Its pivots are copied to
    each and come before the members, so no row carries them."""
    far = set_.loose - (1 - set_.least) - 2 * (set_.least * (1 - set_.least) / BINS) ** 0.5
    if pick is None:  # drawn anew each turn
        pick = F.pmod(F.xxhash64("rep", "key", F.lit(turn)), F.col("size")) < want
    places = F.ceil(F.col("size") / PLACE).cast("int")
    rows = big.select("key", F.pmod(F.xxhash64("rep"), places).cast("int").alias("place"),
                      F.lit(1).alias("member"), "rep", "sketch")
    pivots = big.where(pick).select(
        "key", F.explode(F.sequence(F.lit(0), places - 1)).alias("place"),
        F.lit(0).alias("member"), "rep", "sketch")

    def judged(key, reps, raw, pivots):
        """Rows for a block of members of one bucket."""
        stays = np.ones(len(reps), bool)
        if pivots is not None:
            ids, p, root = pivots
            like = alike(np.frombuffer(b"".join(raw), np.uint16).reshape(-1, BINS), p)
            stays = like.max(axis=1) < set_.loose  # a pivot is like itself
            near = like >= far
            for r in np.unique(root):
                for i in np.flatnonzero(near[:, root == r].any(axis=1)):
                    yield key, reps[i], ids[r], None
        for i in np.flatnonzero(stays):
            yield key, reps[i], None, raw[i]

    def compare(batches):
        place, drawn, pivots = None, [], None
        for batch in batches:
            key, at, member, rep, raw = (batch.column(c).to_pylist() for c in
                                         ("key", "place", "member", "rep", "sketch"))
            out, i = [], 0
            while i < len(key):
                if (key[i], at[i]) != place:
                    place, drawn, pivots = (key[i], at[i]), [], None
                if not member[i]:
                    drawn.append((rep[i], raw[i]))
                    i += 1
                    continue
                if drawn:
                    p = np.frombuffer(b"".join(x[1] for x in drawn), np.uint16).reshape(-1, BINS)
                    pivots, drawn = ([x[0] for x in drawn], p, roots(alike(p, p) >= far)), []
                end = i + 1
                while end < min(len(key), i + 512) and (key[end], at[end]) == place:
                    end += 1
                out += judged(key[i], rep[i:end], raw[i:end], pivots)
                i = end
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())],
                names=["key", "rep", "pivot", "sketch"])

    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.unionByName(pivots).repartition(parts, "key", "place")
            .sortWithinPartitions("key", "place", "member", "rep")
            .mapInArrow(compare, "key long, rep long, pivot long, sketch binary"))


def _split(members: DataFrame) -> DataFrame:
    """(key, rep, sketch) of the members of large buckets, in buckets of the next level."""
    def deal(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                s = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16)
                who, keys = split_keys(part.column("key").to_numpy(), s.reshape(-1, BINS))
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column("rep").take(who), part.column("sketch").take(who)],
                    names=["key", "rep", "sketch"])

    return members.select("key", "rep", "sketch").mapInArrow(deal, "key long, rep long, sketch binary")


def prefix_keys(members: DataFrame, set_: Settings) -> DataFrame:
    """(rep, key): the tokens by which a set can meet one that reaches ``least``.

    ``members`` has root, rep and tokens; sets meet only inside a root. Sets A and B that
    reach ``least`` share at least ``least * n`` tokens of either, so in any order of all tokens
    one of the first ``n - least * n + 1`` of both. The order is from rare to frequent, by counts of MARKS
    hashes of tokens (one aggregate; the counts are broadcast) and then by the token, so that
    no token is moved but those of a prefix. A token of one set only brings it to nobody."""
    def hashed(batches):
        """(reps, tokens' keys, set of each key) for some sets at a time."""
        for batch in batches:
            roots_, reps = (batch.column(c).to_numpy() for c in ("root", "rep"))
            at = 0
            while at < batch.num_rows:
                first, sets, size = at, [], 0
                while at < batch.num_rows and size < 1 << 20:
                    sets.append(np.frombuffer(batch.column("tokens")[at].as_buffer(), "<u4"))
                    size += len(sets[-1])
                    at += 1
                doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                salt = mixed(roots_[first:at].astype(np.uint64) + np.uint64(1))
                yield reps[first:at], mixed(np.concatenate(sets) + salt[doc]), doc

    rows = members.select("root", "rep", "tokens")

    def count(batches):
        held = np.zeros(MARKS, np.int64)
        for _, key, _ in hashed(batches):
            held += np.bincount((key % np.uint64(MARKS)).astype(np.int64), minlength=MARKS)
        slots = np.flatnonzero(held)
        for a in range(0, len(slots), 1 << 16):
            at = slots[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["slot", "held"])

    counts = (rows.mapInArrow(count, "slot long, held long").groupBy("slot")
              .agg(F.sum("held").alias("held")).toArrow())  # at most MARKS rows
    table = np.zeros(MARKS, np.int64)
    table[counts.column("slot").to_numpy()] = counts.column("held").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(table)

    def prefix(batches):
        for reps, key, doc in hashed(batches):
            held = shared.value[(key % np.uint64(MARKS)).astype(np.int64)]
            order = np.lexsort((key, held, doc))
            n = np.bincount(doc, minlength=len(reps))
            length = n - np.ceil(set_.least * n - 1e-9).astype(np.int64) + 1
            rank = np.arange(len(key)) - np.repeat(n.cumsum() - n, n)
            take = order[(rank < np.repeat(length, n)) & (held[order] > 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps[doc[take]]), pa.array(key[take].view(np.int64))], names=["rep", "key"])

    return rows.mapInArrow(prefix, "rep long, key long")


def prefix_links(members: DataFrame, sketches: DataFrame, set_: Settings) -> tuple[DataFrame, list[str]]:
    """Links (a, b) between all sets of one root that may reach ``least``, as forests: none is
    missed but by the error of a sketch, against which ``loose`` stands. ``sketches`` has rep and sketch."""
    keys, path = written(prefix_keys(members, set_))
    sizes, sizes_path = written(buckets_of(keys))
    few = small_buckets(sizes, set_.bucket)
    few, few_path = written(marked(keys, few, "key").join(few, "key"))
    many = sizes.where(F.col("size") > set_.bucket).select("key", F.col("least").alias("b"))
    return (_brute_force(marked(sketches, few, "rep").join(few, "rep").select("key", "rep", "sketch"), set_.loose)
            .unionByName(salted_join(marked(keys, many, "key"), many, "key", "rep").where("rep <> b")
                         .select(F.col("rep").alias("a"), "b"))), [path, sizes_path, few_path]


def candidate_links(reps: DataFrame, sets: DataFrame, set_: Settings) -> tuple[DataFrame, list[str]]:
    """Links (a, b) between representatives that may reach ``least``, as forests.

    ``reps`` has rep, sketch and paths, ``sets`` rep and tokens.
    """
    used: list[str] = []
    rows = (reps.select("rep", F.posexplode("paths").alias("run", "tokens"))
            .select("rep", "run", F.explode("tokens").alias("token"))
            .select("rep", F.xxhash64("run", "token").alias("key")))
    table, path = written(rows)
    used.append(path)
    described = reps.select("rep", "sketch")

    def sized(members):
        """The keys of small buckets, and (key, size) of large ones."""
        sizes, path = written(buckets_of(members))
        few, few_path = written(small_buckets(sizes, set_.bucket))
        used.extend([path, few_path])
        return few, sizes.where(F.col("size") > set_.bucket).select("key", "size")

    def small_of(members):
        return marked(members, few, "key").join(few, "key")

    def large_of(members):
        return salted_join(marked(members, large, "key"), large, "key", "rep")

    def sketched(members):
        """Members with their sketches."""
        members, path = written(members)
        used.append(path)
        return marked(described, members, "rep").join(members, "rep")

    few, large = sized(table)
    # members of small buckets of all levels; a key is small once, so they are compared together
    small = sketched(small_of(table)).select("key", "rep", "sketch")
    big = None if large.isEmpty() else sketched(large_of(table))
    links = []
    for turn in range(1, set_.depth + 1):
        if large.isEmpty():
            break
        table, path = written(big)
        used.append(path)
        judged, path = written(_pivot_round(table, set_, set_.bucket // 2, turn))
        used.append(path)
        links.append(judged.where("pivot IS NOT NULL")
                     .select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        rest = judged.where("sketch IS NOT NULL").select("key", "rep", "sketch")
        few, large = sized(rest)
        small = small.unionByName(small_of(rest).select("key", "rep", "sketch"))
        if turn < set_.depth and not large.isEmpty():
            rest, path = written(_split(large_of(rest)))
            used.append(path)
            few, large = sized(rest)
            small = small.unionByName(small_of(rest).select("key", "rep", "sketch"))
        big = large_of(rest)
    if not large.isEmpty():
        left, left_path = written(big.select("rep").distinct())
        members, path = written(marked(sets, left, "rep").join(left, "rep")
                                .select(F.lit(0).cast("long").alias("root"), "rep", "tokens"))
        more, paths = prefix_links(members, described, set_)
        links.append(more)
        used += [left_path, path, *paths]
    out = _brute_force(small, set_.loose)
    for more in links:
        out = out.unionByName(more)
    return out, used


def taken_apart(nodes: DataFrame, sets: DataFrame, sketches: DataFrame,
                set_: Settings) -> tuple[DataFrame, list[str]]:
    """(node, root) with the largest components taken apart by prefixes; what can reach
    ``least`` with no other set is left out of them."""
    sizes, path = written(nodes.groupBy("root").agg(F.count("*").alias("m")))
    large = sizes.where(F.col("m") > set_.tiles * set_.tile_members).select("root")
    if large.isEmpty():
        return nodes, [path]
    apart, apart_path = written(salted_join(nodes, large, "root", "node").withColumnRenamed("node", "rep"))
    members, members_path = written(marked(sets, apart, "rep").join(apart, "rep").select("root", "rep", "tokens"))
    links, used = prefix_links(members, sketches, set_)
    parts, parts_path = components(links)
    small = sizes.where(F.col("m") <= set_.tiles * set_.tile_members).select("root")
    return (salted_join(nodes, small, "root", "node").select("node", "root")
            .unionByName(parts.select("node", "root"))), [path, apart_path, members_path, parts_path, *used]


# --- step 3: exact links --------------------------------------------------------------

def shared_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of distinct tokens."""
    sizes = [len(s) for s in sets]
    who = np.repeat(np.arange(len(sets)), sizes)
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[token] > 1
    who, token = who[keep], token[keep]
    _, token = np.unique(token, return_inverse=True)
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(token, kind="stable")
    who, token = who[order], token[order]
    width = max(1, min(8192, (1 << 22) // max(len(sets), 1)))
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        lo, hi = np.searchsorted(token, [a, a + width])
        part = np.zeros((len(sets), width), np.float32)
        part[who[lo:hi], token[lo:hi] - a] = 1
        both += part @ part.T
    np.fill_diagonal(both, sizes)
    return both


def blocks_of(nodes: DataFrame, set_: Settings) -> DataFrame:
    """``nodes`` (rep, root, n, ...) with the number of blocks of their component: sides of its tiles."""
    shape = (nodes.groupBy("root").agg(F.count("*").alias("m"), F.max("n").alias("longest"))
             .withColumn("side", F.greatest(F.lit(1), F.least(
                 F.lit(set_.tile_members), F.floor(F.lit(set_.tile_tokens) / F.col("longest")))))
             .select("root", F.ceil(F.col("m") / F.col("side")).cast("int").alias("blocks")))
    return salted_join(nodes, shape, "root", "rep")


def exact_links(members: DataFrame, set_: Settings) -> DataFrame:
    """(rep, links, root): per tile the number of linked rows and the root of
    the tile's true links. ``members`` has rep, root, blocks, copies and tokens."""
    placed = (members
              .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
                      .alias("tile"), "rep", "copies", "block", "tokens",
                      (F.col("block") != F.col("other")).alias("cross")))

    def verify(batches):
        release()  # the word hashes, which no task needs any more
        out: list = []
        for reps, copies, blocks, raw, cross in runs_of(
                batches, "tile", ["rep", "copies", "block", "tokens", "cross"]):
            if len(reps) < 2:
                continue
            sets = [np.frombuffer(r, "<u4") for r in raw]
            if len(sets) == 2:
                both = len(np.intersect1d(sets[0], sets[1]))
                near = both >= set_.least * (len(sets[0]) + len(sets[1]) - both)
                linked = np.array([[False, near], [near, False]])
            else:
                n = np.array([len(s) for s in sets], float)
                both = shared_tokens(sets)
                linked = both >= set_.least * (n[:, None] + n[None] - both)
                np.fill_diagonal(linked, False)
            if cross[0]:
                b = np.array(blocks)
                linked &= b[:, None] != b[None]
            weight = linked @ np.array(copies, np.int64)
            root = roots(linked)
            for i in np.flatnonzero(weight):
                out.append((reps[i], int(weight[i]), reps[root[i]]))
            if len(out) > 20_000:
                yield _links_table(out)
                out = []
        if out:
            yield _links_table(out)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (placed.repartition(parts, "tile").sortWithinPartitions("tile")
            .mapInArrow(verify, "rep long, links long, root long"))


def _links_table(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                      names=["rep", "links", "root"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 settings: Settings = Settings()) -> DataFrame:
    """(_row, _id, class_row, class_id, n_links) for every row of ``docs``:
    the first row of its class, that row's id, and the number of other rows
    at ``least`` similarity or more."""
    sets, sets_path = written(describe_sets(docs, id_col, text_col, settings))
    groups, _ = written(sets.where("n > 0").groupBy("digest")
                        .agg(F.min("_row").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n")))
    # sets without copies are their own representatives, and need not be looked up
    numbered = sets.where("n > 0").select(F.col("_row").alias("rep"), "digest", "sketch", "paths")
    copied = groups.where("copies > 1")
    reps = marked(numbered, copied, "digest", "left_anti").unionByName(
        marked(numbered, copied, "digest").join(groups.select("rep"), "rep", "left_semi"))
    described, described_path = written(reps.select("rep", "sketch", "paths"))
    tokens = sets.select(F.col("_row").alias("rep"), "tokens")
    links, used = candidate_links(described, tokens, settings)
    nodes, nodes_path = components(links)
    nodes, whole_path = written(nodes)
    drop(docs, *used, nodes_path)
    nodes, used = taken_apart(nodes, tokens, described.select("rep", "sketch"), settings)
    nodes, kept_path = written(nodes)
    drop(docs, *used, described_path, whole_path)

    # what a set needs in its component is joined first, so that its tokens are joined once
    placed, _ = written(blocks_of(nodes.withColumnRenamed("node", "rep")
                                  .join(groups.select("rep", "copies", "n"), "rep"), settings))
    exact, _ = written(exact_links(marked(tokens, placed, "rep").join(placed, "rep"), settings))
    classes, _ = components(exact.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (groups.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
             .join(links, "rep", "left")
             .select("digest", "copies", F.coalesce("root", "rep").alias("class_row"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    first = sets.select(F.col("_row").alias("class_row"), F.col("_id").alias("class_id"))
    named, _ = written(named.join(first, "class_row"))
    # at most one row for each PLACE rows
    hot = named.where(F.col("copies") > PLACE).select(
        "digest", F.ceil(F.col("copies") / PLACE).cast("int").alias("__salts"))
    out = skew_join(sets.select("_row", "_id", "digest"), named, "digest", "_row", "left", hot=hot)
    alone = F.col("class_row").isNull()
    return out.select("_row", "_id", F.coalesce("class_row", "_row").alias("class_row"),
                      F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id, n_links, kept (the
    first row of its class)."""
    found = near_classes(docs, id_col, text_col, settings)
    return found.select(F.col("_id").alias(id_col), "class_id", "n_links",
                        (F.col("_row") == F.col("class_row")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` (all columns): one row of each class."""
    # numbered once and written, so that both reads agree on the rows
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered, _ = written(docs.toDF(*names).withColumn("number", F.monotonically_increasing_id()))
    at = dict(zip(docs.columns, names))
    kept = (near_classes(numbered, "number", at[text_col], settings)
            .where("_row = class_row").select(F.col("_id").alias("number")))
    return numbered.join(kept, "number", "left_semi").select(*names).toDF(*docs.columns)
