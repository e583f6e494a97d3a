"""Quality classifier: hashed word n-gram logistic regression trained with
follow-the-regularised-leader updates.

Features are hashed n-grams of the words of a text, of order 1 and 2, over
three spellings: the word itself, its shape (letters folded to ``a``, ``A``
or ``Aa``, digits to ``0``, marks kept and runs shortened), and whether it repeats the word
before it. Each occurrence adds ``1 / sqrt(words)``, so a score is a sparse
dot product with the weights, computed for a whole text at once.

Training is sequential by nature, so it runs on a bounded sample of labelled
rows (``Settings.max_rows``, the rows whose id hashes lowest); scoring reads every whole text
with no shuffle. Only the sample's feature counts and the weights (``2**bits``
floats) pass through the driver.

Defined results: null and empty texts score as the bias alone; labels with a
null quality or id are not used, an id with several labels counts by its
highest; without labelled rows every score is 0.5; repeated rows are scored
each; extra columns are ignored (``filter_quality`` keeps them).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, release, text_or_empty


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    max_rows: int = 8000  # labelled rows to learn from
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"([^\w\s])\1+")
_MAX_WORDS = 300_000  # entries of a task's word table


def shape(word: str) -> str:
    """Case pattern and marks of a word: ``Foo,`` -> ``Aa,``; ``BAR!!`` -> ``A!``."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    at = word.find(core) if core else 0
    head, tail = (word[:at], word[at + len(core):]) if core else ("", word)
    if core.isalpha():
        fold = "a" if core.islower() else "A" if core.isupper() and len(core) > 1 else "Aa"
    else:
        fold = "".join("0" if c.isdigit() else "a" if c.isalpha() else c
                       for c in _DIGITS.sub("0", core))
        fold = re.sub(r"a+", "a", fold)
    return _RUN.sub(r"\1", head) + fold + _RUN.sub(r"\1", tail)


class _Words(dict):
    """word -> number of its (word hash, shape hash) pair, filled on a miss."""

    def __init__(self):
        super().__init__()
        self.word, self.shape = [], []

    def __missing__(self, word):
        n = self[word] = len(self.word)
        raw = word.encode("utf-8", "surrogatepass")
        self.word.append(zlib.crc32(raw))
        self.shape.append(zlib.crc32(shape(word).encode("utf-8", "surrogatepass"), 17))
        return n


class Features:
    """Feature numbers of texts; keeps a bounded table of the words it has seen."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.words = _Words()

    def _pairs(self, h: np.ndarray, salt: int) -> np.ndarray:
        mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)
                 ^ (h[1:] + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F))
        return (mixed * np.uint64(0xFF51AFD7ED558CCD)) >> self.shift

    def _single(self, h: np.ndarray, salt: int) -> np.ndarray:
        return ((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def many(self, texts: list[str]):
        """Per text, the feature number of each occurrence (with repeats)."""
        if len(self.words) > _MAX_WORDS:
            self.words = _Words()
        numbers = [np.fromiter(map(self.words.__getitem__, t.split()), np.int64)
                   for t in texts]
        word = np.array(self.words.word, np.uint64)
        shapes = np.array(self.words.shape, np.uint64)
        for n in numbers:
            w, s = word[n], shapes[n]
            same = (w[:-1] == w[1:]).astype(np.uint64)
            yield np.concatenate([self._single(w, 1), self._pairs(w, 2), self._single(s, 3),
                                  self._pairs(s, 4), self._single(same, 5)]), len(n)


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows (numbers, values)."""

    def __init__(self, settings: Settings):
        size = (1 << settings.bits) + 1  # the last weight is the bias
        self.set, self.z, self.n = settings, np.zeros(size), np.zeros(size)

    def weights_at(self, i: np.ndarray) -> np.ndarray:
        s, z = self.set, self.z[i]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[i])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights_at(i)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.set.alpha * w
        self.n[i] += g * g

    def weights(self) -> np.ndarray:
        return self.weights_at(np.arange(len(self.z))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", settings: Settings = Settings(), usable=None) -> np.ndarray:
    """Weights learned from at most ``settings.max_rows`` labelled rows.

    ``usable`` (a condition on the labels' ``id_col``) restricts which ids are learned from.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    sample = (known.groupBy(F.col(id_col).alias("_id"))
              .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(settings.max_rows))
    rows = (docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
            .join(F.broadcast(sample), "_id"))  # at most max_rows rows

    def count(batches):
        release()
        features = Features(settings.bits)
        for batch in batches:
            out = []
            texts = [t.as_py() for t in batch.column("_text")]
            for key, label, (numbers, words) in zip(batch.column("_id").to_pylist(),
                                                    batch.column("_label").to_pylist(),
                                                    features.many(texts)):
                i, n = np.unique(numbers, return_counts=True)
                out.append((str(key), label, i.astype("<i4").tobytes(),
                            (n / np.sqrt(max(words, 1))).astype("<f4").tobytes()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                names=["id", "label", "i", "x"])

    found = rows.mapInArrow(count, "id string, label int, i binary, x binary").collect()
    found.sort(key=lambda r: (zlib.crc32(r.id.encode()), r.id, bytes(r.i)))
    model = Ftrl(settings)
    bias = np.array([1 << settings.bits])
    for _ in range(settings.epochs):
        for r in found:
            i = np.concatenate([np.frombuffer(r.i, "<i4"), bias])
            x = np.concatenate([np.frombuffer(r.x, "<f4"), [1.0]])
            model.learn(i, x, int(r.label > 0))
    return model.weights()


def _scored(rows: DataFrame, weights: np.ndarray, settings: Settings, text_at: int,
            score_col: str) -> DataFrame:
    """``rows`` with a last column ``score_col``."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats
    schema = StructType([*rows.schema.fields, StructField(score_col, DoubleType())])

    def score(batches):
        release()
        w = shared.value
        features = Features(settings.bits)
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 256):
                part = batch.column(text_at).slice(a, 256)
                for numbers, words in features.many([t.as_py() or "" for t in part]):
                    logit = w[-1] + w[numbers].sum(dtype=np.float64) / np.sqrt(max(words, 1))
                    out.append(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.float64())],
                names=[*batch.schema.names, score_col])

    return rows.mapInArrow(score, schema)


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id",
                  text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: ``id_col``, score (0 to 1, higher: better), predicted."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = _scored(rows, weights, settings, 1, "score")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text",
                   settings: Settings = Settings(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) that score at least ``least``."""
    at = docs.columns.index(text_col)
    name = free_name(docs.columns, "_score")
    return _scored(docs, weights, settings, at, name).where(F.col(name) >= least).drop(name)
