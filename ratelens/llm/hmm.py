"""Hidden Markov language model over whole texts.

Tokens are the words of the text with A-Z lower-cased, then one end token.
The model emits from its latent states one of a bounded set of symbols: the
most frequent words and the end token are symbols of their own, every other
word falls into one of ``buckets`` by its crc32 and is then drawn from the
bucket's smoothed word counts. So

    P(text) = P_hmm(symbols) * prod P(word | bucket)

is a proper distribution, the state tables stay small, and the word counts
may grow with the corpus: they live in a distributed table that is joined,
never collected.

* Word counts: per-task counts, then one shuffle. The ``Settings.lookup``
  most frequent words (a fixed number) go to every task; only the rarer ones
  are joined, as (row, word, times).
* Baum-Welch: tasks run the scaled forward and backward recursions (scaled every
  few steps, as far apart as the tables keep them from underflow) over all
  training sequences and add up expected counts per (symbol, state); Spark
  sums them, the driver normalises ``states x symbols`` numbers. Every pass
  (``start_passes + passes``, 10) reads all training rows whole.
* Scores: the scaled forward recursion, exact at any length.

Training cuts sequences above ``Settings.block`` tokens into blocks; scoring does not.

Defined results: null text is empty (one end token); null ids count as the
empty id text; repeated rows are counted and scored each; an empty table
gives no rows; without training rows the counts are 0; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from copy import copy
from dataclasses import dataclass
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

END = b""  # the end token; words are never empty
TOGETHER = 2_000_000  # tokens whose recursions run together
WINDOW = 8_000_000  # tokens of the sequences that are put in order of length
COUNTED = 4_000_000  # words counted in one table
ROW = 64  # what a sequence takes beside its tokens
CHARS = 4 << 20  # bytes of texts whose words are looked up together


@dataclass(frozen=True)
class Settings:
    states: int = 8
    frequent: int = 8191  # words that are symbols of their own
    buckets: int = 8192
    lookup: int = 1 << 16  # at most so many frequent words go to every task, with their counts
    start_rows: int = 0  # not read any more: no pass is over a sample
    start_passes: int = 8  # these and ``passes`` are all over all training rows
    passes: int = 2
    block: int = 500_000
    smooth: float = 0.02
    seed: int = 7

    @property
    def symbols(self) -> int:
        return 1 + self.frequent + self.buckets


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased and split on the six ASCII white spaces, and where each
    text's words start, with the last one's stop; an end token follows those of each text."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = found.flatten()
    at = found.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    full = pc.binary_length(words).to_numpy() > 0  # not what lies beside white space at an end
    if not full.all():
        words, at = words.filter(pa.array(full)), np.concatenate([[0], full.cumsum()])[at]
    return words, at


def slices(column: pa.Array, chars: int):
    """(first row, rows) of about ``chars`` bytes of texts."""
    ends = (pc.binary_length(column).to_numpy().astype(np.int64) + ROW).cumsum()
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + chars)) + 1
        yield first, column.slice(first, last - first)
        first = last


# --- scaled recursions over many sequences at once ------------------------------

class Batch:
    """Sequences laid out step by step, longest first, so that step ``t`` of
    all sequences still running is one contiguous slice."""

    def __init__(self, seqs: list[np.ndarray]):
        self.order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        sizes = np.array([len(seqs[i]) for i in self.order], np.int64)
        steps = int(sizes[0]) if len(sizes) else 0
        # running[t]: sequences longer than t
        self.running = (len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right"))
        self.at = np.concatenate([[0], self.running.cumsum()]).astype(np.int64)
        self.syms = np.empty(int(self.at[-1]), np.int64)
        for row, i in enumerate(self.order):
            s = seqs[i]
            self.syms[self.at[:len(s)] + row] = s


class Model:
    """Start, transition (state x state) and emission (symbol x state) tables."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, counts: np.ndarray, set_: Settings) -> "Model":
        """Sticky states whose emissions are the symbol counts, perturbed."""
        rng = np.random.default_rng(set_.seed)
        k = set_.states
        emit = (counts[:, None] + 0.5) * rng.gamma(2.0, 1.0, (len(counts), k))
        move = np.full((k, k), 0.05 / max(k - 1, 1))
        np.fill_diagonal(move, 0.95 if k > 1 else 1.0)
        return cls(np.full(k, 1.0 / k), move, emit / emit.sum(axis=0))

    def stride(self) -> int:
        """After how many steps the rows are scaled: the sum of a row falls by no more than ``least``
        a step, so it stays above 1e-200 until then and what gets lost below is no part of it."""
        least = min((self.emit @ self.move.T).min(), (self.emit @ self.start).min())
        return int(np.clip(200 / max(-log10(least), 1.0), 1, 16)) if least > 0 else 1

    def forward(self, batch: Batch, keep: bool = False):
        """Natural-log likelihood per sequence (in batch order); with ``keep`` also
        the forward rows, their scales by step, and the sum of each sequence's last row."""
        k, every = len(self.start), self.stride()
        running, at = batch.running.tolist(), batch.at.tolist()
        n = running[0] if running else 0
        # without ``keep`` two steps are held, by turns
        rows = np.empty((len(batch.syms), k)) if keep else np.empty((2, n, k))
        loglik, ends, ones, into = np.zeros(n), np.ones(n), np.ones(k), np.empty((n, k))
        scales, a = {}, None
        for t, live in enumerate(running):
            before, a = a, rows[at[t]:at[t + 1]] if keep else rows[t % 2, :live]
            self.emit.take(batch.syms[at[t]:at[t + 1]], axis=0, out=a, mode="clip")
            a *= self.start if before is None else np.matmul(before[:live], self.move,
                                                             out=into[:live])
            if t % every == every - 1:
                c = scales[t] = a @ ones
                a /= c[:, None]
                loglik[:live] += np.log(c)
            stay = running[t + 1] if t + 1 < len(running) else 0
            if stay < live:  # sequences that end here
                ends[stay:live] = a[stay:] @ ones
        loglik += np.log(ends)
        return (loglik, rows, scales, ends) if keep else loglik

    def expected(self, batch: Batch):
        """Expected counts of starts, moves and emissions over the batch."""
        loglik, rows, scales, ends = self.forward(batch, keep=True)
        k, running, at = len(self.start), batch.running.tolist(), batch.at.tolist()
        n = running[0] if running else 0
        moves, turned = np.zeros((k, k)), np.ascontiguousarray(self.move.T)
        # the last step's backward rows are such that forward and backward row multiply to sum 1
        last, back, below, have = 1 / ends[:, None], np.empty((n, k)), np.empty((n, k)), 0
        emits, state, top = np.zeros(self.emit.size), np.arange(k), len(batch.syms)
        for t in range(len(running) - 1, -1, -1):
            lo, hi, live = at[t], at[t + 1], running[t]
            if have < live:  # sequences that end here
                back[have:live], have = last[have:live], live
            b = back[:live]
            if t:
                w = self.emit.take(batch.syms[lo:hi], axis=0, out=below[:live], mode="clip")
                w *= b
                if t in scales:
                    w /= scales[t][:, None]
                moves += rows[at[t - 1]:at[t - 1] + live].T @ w
                rows[lo:hi] *= b
                np.matmul(w, turned, out=b)
            else:
                rows[lo:hi] *= b
            if top - lo >= 1 << 15 or not t:  # rows that are done, a bounded number at once
                emits += np.bincount((batch.syms[lo:top, None] * k + state).ravel(),
                                     rows[lo:top].ravel(), len(emits))
                top = lo
        moves *= self.move
        seen = np.flatnonzero(np.bincount(batch.syms, minlength=len(self.emit)))
        return loglik.sum(), rows[:n].sum(axis=0), moves, seen, emits.reshape(-1, k)[seen]

    @classmethod
    def fitted(cls, start, moves, emits, counts, smooth: float) -> "Model":
        """Normalised expected counts; emissions are smoothed towards the corpus counts."""
        k = len(start)
        base = (counts + 0.5) / (counts + 0.5).sum()
        emit = emits + smooth * len(counts) * base[:, None] / k
        return cls((start + 1) / (start + 1).sum(),
                   (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def grouped(seqs):
    """(places, sequences) of about ``TOGETHER`` tokens in all: of a window of sequences
    those alike in length go together, so that most of a batch runs at each of its steps."""
    window, size, first = [], 0, 0

    def parts():
        order = sorted(range(len(window)), key=lambda i: len(window[i]))
        places, held = [], 0
        for i in order:
            places.append(i)
            held += len(window[i]) + ROW
            if held >= TOGETHER or i == order[-1]:
                yield [first + j for j in places], [window[j] for j in places]
                places, held = [], 0

    for s in seqs:
        window.append(s)
        size += len(s) + ROW
        if size >= WINDOW:
            yield from parts()
            first += len(window)
            window, size = [], 0
    yield from parts()


# --- distributed steps ----------------------------------------------------------

def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``rows`` (column _text)."""
    def count(batches):
        held: list = []

        def table():
            found = pa.chunked_array(held).value_counts()
            held.clear()
            for a in range(0, len(found), 100_000):
                part = found.slice(a, 100_000).flatten()
                yield pa.RecordBatch.from_arrays([part[0].cast(pa.binary()), part[1]],
                                                 names=["word", "c"])

        texts = size = 0
        for batch in batches:
            texts += batch.num_rows
            for _, part in slices(batch.column("_text"), CHARS):
                words, _ = split_words(part)
                held.append(words)
                size += len(words)
                if size >= COUNTED:
                    yield from table()
                    size = 0
        if held:
            yield from table()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([texts], pa.int64())],
                                             names=["word", "c"])

    return (rows.select("_text").mapInArrow(count, "word binary, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


class Vocabulary:
    """What every task needs: sizes, the frequent words and the buckets' totals (all bounded)."""

    def __init__(self, words: DataFrame, set_: Settings):
        self.set = set_
        n, v = words.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = int(n or 0), int(v or 0)
        # The most frequent words by a cut on the count, not by a top-k, which
        # would send k rows of every task to the driver. Words that share a
        # bin of counts (16 bins per doubling) are looked up together or not at all.
        steps = words.where(F.col("word") != F.lit(b"")).withColumn(
            "bin", F.floor(F.log2("c") * 16))
        cut, total = None, 0
        for r in sorted(steps.groupBy("bin").count().collect(), reverse=True):  # about 1,000 rows
            total += r["count"]
            if total > set_.lookup:
                break
            cut = r.bin
        top = steps.where(F.col("bin") >= cut if cut is not None else F.lit(False)).toArrow()
        ranked = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist()),
                        key=lambda x: (-x[0], x[1]))
        self.known = {w: (c, i) for i, (c, w) in enumerate(ranked)}
        own = {w for w, (_, i) in self.known.items() if i < set_.frequent}
        end = words.where(F.col("word") == F.lit(b"")).first()
        self.end = int(end.c) if end else 0
        self.counts = np.zeros(set_.symbols)  # training tokens per symbol
        self.types = np.zeros(set_.symbols)   # distinct training words per symbol
        for r in words.groupBy((F.crc32("word") % set_.buckets).alias("b")).agg(
                F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            self.counts[1 + set_.frequent + r.b] = r.c
            self.types[1 + set_.frequent + r.b] = r.v
        for w, s in [(w, 1 + self.known[w][1]) for w in own] + [(END, 0)]:
            c = self.known[w][0] if w else self.end
            b = 1 + set_.frequent + zlib.crc32(w) % set_.buckets
            self.counts[s], self.types[s] = c, 1
            if c:
                self.counts[b] -= c
                self.types[b] -= 1

    def bucket(self, word: bytes) -> int:
        return 1 + self.set.frequent + zlib.crc32(word) % self.set.buckets


class _Words(dict):
    """word -> (symbol, known, log10 base, log10 in bucket, rare) by the vocabulary; bounded."""

    def __init__(self, voc: Vocabulary):
        super().__init__()
        self.voc = voc
        self.base = log10(voc.n + voc.v + 1)
        self[END] = (0, int(voc.end > 0), log10(voc.end + 1) - self.base, 0.0, False)

    def __missing__(self, word):
        voc = self.voc
        found = voc.known.get(word)
        if found is None:
            entry = (voc.bucket(word), 0, 0.0, 0.0, True)
        else:
            c, rank = found
            base = log10(c + 1) - self.base
            if rank < voc.set.frequent:
                entry = (1 + rank, 1, base, 0.0, False)
            else:
                b = voc.bucket(word)
                entry = (b, 1, base, log10(c + 1) - log10(voc.counts[b] + voc.types[b] + 1), False)
        if len(self) < 500_000:
            self[word] = entry
        return entry


class _Numbers:
    """Numbers of words: the end token and the looked-up words first, whose columns hold what
    ``_Words`` tells of them, then rare words as they come. Starts anew once it is full."""

    def __init__(self, voc: Vocabulary):
        self.near = [END, *voc.known]
        # one more row, all 0, stands for every rare word
        syms, known, base, inside, _ = zip(*map(_Words(voc).__getitem__, self.near))
        self.known = np.array([*known, 0], np.int64)
        self.base, self.inside = np.array([*base, 0.0]), np.array([*inside, 0.0])
        self.near_syms = np.array(syms, "<u2")
        self.first, self.buckets = 1 + voc.set.frequent, voc.set.buckets

    def start(self) -> None:
        self.table = dict(zip(self.near, range(len(self.near))))
        self.rare, self.syms = [], self.near_syms

    def of(self, words: pa.Array) -> np.ndarray:
        if len(self.rare) > 400_000:
            self.start()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.table.get, distinct, repeat(-1)), np.int64, len(distinct))
        at = np.flatnonzero(found < 0)
        found[at] = np.arange(len(at)) + len(self.table)
        new = [distinct[i] for i in at.tolist()]
        self.table.update(zip(new, found[at].tolist()))
        self.rare += new
        buckets = np.fromiter(map(zlib.crc32, new), np.int64, len(new)) % self.buckets
        self.syms = np.concatenate([self.syms, (self.first + buckets).astype("<u2")])
        return found[coded.indices.to_numpy()]


def encode_rows(rows: DataFrame, voc: Vocabulary) -> DataFrame:
    """Symbols of every row, the sums that need no join, and its rare words with their number of times."""
    shared = rows.sparkSession.sparkContext.broadcast(_Numbers(voc))
    words_times = pa.struct([("word", pa.binary()), ("times", pa.int64())])

    def encode(batches):
        table = copy(shared.value)  # what a task adds goes with it
        table.start()
        limit = len(table.near)
        for batch in batches:
            for first, texts in slices(batch.column("_text"), CHARS):
                part = batch.slice(first, len(texts))
                words, at = split_words(texts)
                stops = at[1:] + np.arange(1, len(at))  # with the end tokens
                starts = at[:-1] + np.arange(len(texts))
                numbers = np.zeros(stops[-1], np.int64)  # an end token is number 0
                inner = np.ones(len(numbers), bool)
                inner[stops - 1] = False
                numbers[inner] = table.of(words)
                near = np.minimum(numbers, limit)
                raw = table.syms[numbers].tobytes()
                far = np.flatnonzero(near == limit)
                text = np.searchsorted(stops, far, "right")
                span = len(table.rare) + 1
                pairs, times = np.unique(text * span + (numbers[far] - limit), return_counts=True)
                text, word = np.divmod(pairs, span)
                rare = pa.StructArray.from_arrays(
                    [pa.array([*map(table.rare.__getitem__, word.tolist())], pa.binary()),
                     pa.array(times, pa.int64())], fields=[*words_times])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_id"), part.column("held_out"),
                     pa.array(stops - starts, pa.int64()),
                     pa.array([raw[2 * a:2 * b] for a, b in zip(starts.tolist(), stops.tolist())],
                              pa.binary()),
                     *(pa.array(np.add.reduceat(column[near], starts))
                       for column in (table.known, table.base, table.inside)),
                     pa.ListArray.from_arrays(
                         pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()),
                         rare)],
                    names=["_row", "_id", "held_out", "n_tokens", "syms", "known", "base",
                           "inside", "rare"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        encode, f"_row long, _id {kind}, held_out boolean, n_tokens long, syms binary, known long, "
                "base double, inside double, rare array<struct<word: binary, times: bigint>>")


def baum_welch_pass(seqs: DataFrame, model: Model, counts: np.ndarray, set_: Settings) -> Model:
    """One pass over all sequences (column syms): expected counts per symbol
    and state are summed by Spark, then normalised."""
    k = set_.states
    shared = seqs.sparkSession.sparkContext.broadcast(model)
    names = [f"s{j}" for j in range(k)]

    def expect(batches):
        m = shared.value
        start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((set_.symbols, k))

        def cut():
            for batch in batches:
                for raw in batch.column("syms"):
                    s = np.frombuffer(raw.as_py(), "<u2")
                    for a in range(0, len(s), set_.block):
                        yield s[a:a + set_.block]

        for _, part in grouped(cut()):
            _, st, mv, seen, em = m.expected(Batch(part))
            start += st
            moves += mv
            emits[seen] += em
        table = np.concatenate([start[None], moves, emits])
        keys = np.arange(len(table)) - 1 - k  # start, moves, then symbols from 0
        at = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[at])] + [pa.array(table[at, j]) for j in range(k)],
            names=["symbol", *names])

    sums = (seqs.select("syms").mapInArrow(expect, "symbol long, "
                                           + ", ".join(f"{n} double" for n in names))
            .groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).collect())
    table = np.zeros((1 + k + set_.symbols, k))
    for r in sums:
        table[r.symbol + 1 + k] = r[1:]
    return Model.fitted(table[0], table[1:1 + k], table[1 + k:], counts, set_.smooth)


def train(seqs: DataFrame, counts: np.ndarray, set_: Settings) -> Model:
    """Baum-Welch from the seeded start, every pass over all sequences."""
    model = Model.first(counts, set_)
    if not counts.any():  # no training rows
        return model
    for _ in range(set_.start_passes + set_.passes):
        model = baum_welch_pass(seqs, model, counts, set_)
    return model


def score_sequences(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without syms and rare, plus hmm: log10 likelihood of the symbols."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c not in ("syms", "rare")]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches):
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for places, part in grouped(np.frombuffer(s.as_py(), "<u2")
                                        for s in batch.column("syms")):
                b = Batch(part)
                out[np.array(places)[b.order]] = m.forward(b) / np.log(10.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(out)], names=[*keep, "hmm"])

    return rows.drop("rare").mapInArrow(score, f"{kinds}, hmm double")


def score_language(docs: DataFrame, id_col: str, text_col: str, held_out: Column,
                   settings: Settings = Settings()) -> DataFrame:
    """Train on the rows where ``held_out`` is false and score every row.

    Returns ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"),
                       F.col(id_col).alias("_id"), held_out.alias("held_out"),
                       text_or_empty(text_col).alias("_text"))
    words, _ = written(count_words(rows.where(~F.col("held_out"))))
    voc = Vocabulary(words, settings)
    coded, _ = written(encode_rows(rows, voc))
    model = train(coded.where(~F.col("held_out")).select("_row", "syms"), voc.counts, settings)
    scored = score_sequences(coded, model)

    whole = voc.n + voc.v + 1
    spark = docs.sparkSession
    totals = spark.createDataFrame(  # one row a bucket
        [(b, float(voc.counts[1 + settings.frequent + b] + voc.types[1 + settings.frequent + b] + 1))
         for b in range(settings.buckets)], "b int, total double")
    rare = (coded.select("_row", F.inline("rare"))
            .join(words, "word", "left")
            .withColumn("b", (F.crc32("word") % settings.buckets).cast("int"))
            .join(F.broadcast(totals), "b")
            .withColumn("c", F.coalesce("c", F.lit(0)))
            .groupBy("_row").agg(
                F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("r_known"),
                F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(whole)))).alias("r_base"),
                F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.col("total"))).alias("r_inside")))
    zero = F.lit(0.0)
    return (scored.join(rare, "_row", "left")
            .select(F.col("_id").alias(id_col), "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
                    F.lit(voc.n).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"),
                    (F.col("hmm") + F.col("inside") + F.coalesce("r_inside", zero)).alias("score")))
