"""Vector codes by product quantisation, in whole numbers from end to end.

A vector's components become ``floor(1024 x)`` and are cut into equal parts;
every part is coded by the nearest entry of the codebook of its position. The
nearest entry is found on integer Walsh-Hadamard coefficients: parts and
entries are padded with zeros to a power of two ``n`` and transformed with
additions only. The squared differences of the coefficients sum to ``n`` times the
squared distance, so a sum over the first coefficients in sequency order (by
number of sign changes) never exceeds the whole one. All entries are
compared on the first ones; the best of them is summed whole and bounds the
rest; after each further block the entries above the bound are out. What
remains is exact, ties included: no floating point takes part.

Rows are read once per round by tasks that hold the codebooks (entries x
dimension, bounded) and send sums per entry, at most one number per entry and
component each; Spark adds them. Sums are of whole numbers, so any order
of tasks, or a task run again, gives the same codebooks.

Defined results: rows whose vector is null or holds a null, NaN or infinite
component are left out. The dimension is the longest vector's, rounded up to a
multiple of the parts; shorter vectors are read with zeros behind. Starting entries
are the rows of smallest id, null ids last, equal ids by their components;
with fewer rows than entries each row is one. Numbers that leave 63 bits are
computed exactly as Python integers; errors above a long are given as the largest
long. Repeated rows are rows of their own, extra columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checked_broadcast
from .common import written

SCALE = 1024
LIMB = 31  # bits of a summed limb
LONGEST = (1 << 63) - 1
SALTS = 16  # of a label's rows, when the labels are too many to broadcast


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    block: int = 4  # coefficients between two eliminations
    few: float = 1 / 16  # share of entries still open below which pairs are summed one by one
    rows: int = 512  # compared at a time


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of size ``n`` by their number of sign changes."""
    bits = n.bit_length() - 1
    s = np.arange(n)
    gray, out = s ^ (s >> 1), np.zeros(n, np.int64)
    for b in range(bits):
        out |= (gray >> b & 1) << (bits - 1 - b)
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the last axis (a power of two), in sequency order."""
    n = x.shape[-1]
    y, step = x, 1
    while step < n:
        z = y.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        a, b = z[..., 0, :], z[..., 1, :]
        y = np.stack([a + b, a - b], axis=-2).reshape(x.shape)
        step *= 2
    return y[..., sequency_order(n)]


def padded(x: np.ndarray) -> np.ndarray:
    """Zeros behind the last axis, up to a power of two."""
    width = x.shape[-1]
    n = 1 << max(0, width - 1).bit_length()
    out = np.zeros((*x.shape[:-1], n), x.dtype)
    out[..., :width] = x
    return out


class Codebook:
    """The entries of one part position, ready to be searched."""

    def __init__(self, entries: np.ndarray, settings: Settings):
        self.block, self.few = settings.block, settings.few
        self.coefficients = np.ascontiguousarray(transform(padded(entries)).T)  # [n, entries]

    def _summed(self, x: np.ndarray, rows, entries, a: int, b: int):
        """Squared differences of coefficients ``a`` to ``b`` of (row, entry) pairs."""
        d = x[a:b, rows] - self.coefficients[a:b, entries]
        return (d * d).sum(axis=0)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part, ties to the lower index, and the squared distance."""
        x = np.ascontiguousarray(transform(padded(parts)).T)  # [n, rows]
        n, count = x.shape
        every, bound = np.arange(count), None
        partial = np.zeros((count, self.coefficients.shape[1]), x.dtype)
        done, open_ = 0, None
        while done < n and (open_ is None or np.count_nonzero(open_) > self.few * open_.size):
            for k in range(done, min(done + self.block, n)):  # all entries side by side
                d = x[k][:, None] - self.coefficients[k]
                d *= d
                partial += d
            done = min(done + self.block, n)
            best = partial.argmin(axis=1)
            whole_sum = partial[every, best] + self._summed(x, every, best, done, n)
            bound = whole_sum if bound is None else np.minimum(bound, whole_sum)
            open_ = partial <= bound[:, None]
        rows, entries = np.nonzero(open_)
        sums = partial[rows, entries]
        for a in range(done, n, self.block):  # few are left: pair by pair
            sums = sums + self._summed(x, rows, entries, a, min(a + self.block, n))
            stay = sums <= bound[rows]
            rows, entries, sums = rows[stay], entries[stay], sums[stay]
        # pairs are ordered by row and entry, and each row has one
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(sums, starts)
        at = np.flatnonzero(sums == least[rows])
        at = at[np.diff(rows[at], prepend=-1) > 0]
        return entries[at], least // n


def whole(values: np.ndarray, kind: str) -> np.ndarray:
    """``floor(1024 x)`` as integers of this kind (int32, int64, or object: Python integers)."""
    values = values.astype(np.float64)
    if kind != "object":
        return np.floor(values * SCALE).astype(kind)  # a power of two: the product is exact
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(v) * SCALE if abs(v) >= 2.0 ** 52 else int(np.floor(v * SCALE))
                      for v in values.ravel()]
    return out


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Whole components of a column of lists; zeros behind the shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = whole(column.flatten().to_numpy(zero_copy_only=False), kind)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _kept(vector: str) -> Column:
    def finite(c):
        x = c.cast("double")
        return c.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _limbs(total) -> Iterator[int]:
    """Signed top limb last: ``sum(limb << 31 i)`` is ``total``."""
    total = int(total)
    while not -(1 << 62) <= total < 1 << 62:
        yield total & ((1 << LIMB) - 1)
        total >>= LIMB
    yield total


class Coder:
    """Codebooks of all part positions; what a task needs to code rows."""

    def __init__(self, books: np.ndarray, settings: Settings):
        self.books, self.settings = books, settings  # [parts, entries, width]
        self.search = [Codebook(b, settings) for b in books]

    def coded(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of rows: first row, parts [rows, parts, width], entries and squared distances [parts, rows]."""
        parts, _, width = self.books.shape
        for a in range(0, len(column), self.settings.rows):
            x = _matrix(column.slice(a, self.settings.rows), parts * width, self.books.dtype.name)
            x = x.reshape(len(x), parts, width)
            found = [s.nearest(x[:, p]) for p, s in enumerate(self.search)]
            yield a, x, np.array([e for e, _ in found]), np.array([d for _, d in found])


def _lists(batch: pa.RecordBatch) -> pa.Array:
    return pa.concat_arrays([batch.column("v")])


def _sums(rows: DataFrame, books: np.ndarray, settings: Settings) -> np.ndarray:
    """One round: the sum and number of the parts of every entry decide the new entries."""
    parts, size, width = books.shape

    def add(batches):
        coder = Coder(books, settings)
        wide = books.dtype == object
        total = np.zeros((parts, size, width + 1), object if wide else np.int64)
        for batch in batches:
            for _, x, entries, _ in coder.coded(_lists(batch)):
                for p in range(parts):
                    np.add.at(total[p, :, :width], entries[p], x[:, p])
                    total[p, :, width] += np.bincount(entries[p], minlength=size)
        flat = total.ravel()
        at = np.flatnonzero(flat != 0)
        if wide:
            out = [(int(i), k, v) for i in at for k, v in enumerate(_limbs(flat[i]))]
            slots, limbs, values = (list(c) for c in zip(*out)) if out else ([], [], [])
        else:
            slots, limbs, values = at, np.zeros(len(at), np.int32), flat[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int64()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())],
            names=["slot", "limb", "value"])

    # at most parts x entries x (width + 1) slots come back
    sums = (rows.select("v").mapInArrow(add, "slot long, limb int, value long")
            .groupBy("slot", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")))
    total = np.zeros(parts * size * (width + 1), object)
    for r in sums.toLocalIterator():
        total[r.slot] += int(r.value) << (LIMB * r.limb)
    total = total.reshape(parts, size, width + 1)
    new = books.copy()
    used = total[:, :, width] > 0
    new[used] = (total[used][:, :width] // total[used][:, width:]).astype(books.dtype)
    return new


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def train_codebooks(rows: DataFrame, settings: Settings = Settings()) -> np.ndarray | None:
    """Codebooks [parts, entries, width] of ``rows`` (id, v: kept vectors), in integers wide
    enough for every sum of a search; None without rows."""
    size = F.aggregate("v", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c.cast("double"))))
    longest, largest = rows.agg(F.max(F.size("v")), F.max(size)).first()
    if longest is None:
        return None
    width = -(-longest // settings.parts)
    n = 1 << max(0, width - 1).bit_length()
    # n^2 (2 B)^2 bounds a sum of scaled squares, B the largest component
    most = int(largest * SCALE) + 1 if largest < 1 << 40 else (int(largest) + 1) * SCALE
    bound = (2 * n * most) ** 2
    kind = "int32" if bound < 1 << 31 else "int64" if bound < 1 << 62 else "object"
    first = (rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(settings.entries)
             .select("v").toArrow())
    column = pa.concat_arrays(first.column("v").chunks)
    start = _matrix(column, settings.parts * width, kind)
    books = start.reshape(len(start), settings.parts, width).transpose(1, 0, 2).copy()
    for _ in range(settings.rounds):
        books = _sums(rows, books, settings)
    return books


def encode_vectors(rows: DataFrame, books: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """``rows`` (id, label, v) as id, label, code (hex, two digits a part) and error (decimal)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))

    def encode(batches):
        coder = Coder(books, settings)
        names = np.array([f"{i:0{digits}x}" for i in range(books.shape[1])], object)
        for batch in batches:
            codes, errors = [], []
            for _, _, entries, distances in coder.coded(_lists(batch)):
                codes += names[entries].sum(axis=0).tolist()
                errors += distances.astype(object).sum(axis=0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(codes, pa.string()),
                 pa.array([Decimal(min(int(e), LONGEST)) for e in errors], pa.decimal128(38, 0))],
                names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(
        encode, f"id {kinds['id']}, label {kinds['label']}, code string, error decimal(38,0)")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """One row per kept vector: ``id_col``, code, error, label_error (sum of error over
    equal labels) and codebooks_sha256."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = (vectors.where(_kept(vector_col))
            .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                    F.col(vector_col).alias("v")))
    books = train_codebooks(rows, settings)
    if books is None:
        return vectors.sparkSession.createDataFrame(
            [], f"{id_col} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded, _ = written(encode_vectors(rows, books, settings))
    longest = F.lit(LONGEST).cast("decimal(38,0)")
    sums = (coded.groupBy(F.col("label").alias("_label"))
            .agg(F.least(F.sum("error"), longest).cast("long").alias("label_error")))
    few = checked_broadcast(sums)
    same = F.col("label").eqNullSafe(F.col("_label"))
    if few is not sums:
        joined = coded.join(few, same)
    else:  # many labels: one of them may still hold a third of the rows
        spread = sums.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = coded.withColumn("_at", F.pmod(F.hash("id", "code"), F.lit(SALTS)))
        joined = salted.join(spread, same & (F.col("_at") == F.col("_salt")))
    return joined.select(
        F.col("id").alias(id_col), "code", F.col("error").cast("long").alias("error"),
        "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
