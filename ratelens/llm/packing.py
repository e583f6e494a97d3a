"""Vector bin packing of examples into fixed-length training sequences.

Every example is a vector (tokens, segments, loss-bearing tokens) and every
sequence has a capacity in each. The dot-product heuristic fills one open
sequence at a time: of the waiting examples that fit, take the one whose
vector (as fractions of the capacities) has the largest dot product with the
capacity that is left.

Work is per input partition: no shuffle, no driver state, and a bounded set
of waiting examples (``WINDOW``), so memory does not grow with the input and
a lost task is simply run again with the same result. Sequence ids carry the
partition number in their upper bits.

Defined results: null text is empty (its only token is the end id); null ids
stay null; repeated rows are packed each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import encoder

WINDOW = 256  # waiting examples that the heuristic chooses from
_PARTITION_SHIFT = 40


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


class Packer:
    """Fills sequences one at a time from a bounded window of examples.

    ``cut`` lets an example be divided (pre-training text, where every token
    bears loss); without it an example is placed whole or, when it exceeds a
    capacity by itself, given a sequence of its own.
    """

    def __init__(self, limits: Limits, cut: bool, first_id: int):
        self.lim, self.cut, self.next_id = limits, cut, first_id
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.most = min(limits.tokens, limits.loss_tokens)  # of one cut piece
        self.need = np.zeros((WINDOW, 3))
        self.keys: list = [None] * WINDOW
        self.n = 0
        self.open: list = []
        self.left = self.cap.copy()

    def add(self, key, start: int, tokens: int, loss: int) -> Iterator[tuple]:
        """Offer an example (or the rest of one); yields placed pieces."""
        while self.cut and tokens >= self.most and self.most:
            # a piece that fills a sequence by itself needs no choice
            yield from self._close([(key, start, self.most)])
            start, tokens, loss = start + self.most, tokens - self.most, loss - self.most
        if not tokens:
            return
        if not self.cut and (tokens > self.lim.tokens or loss > self.lim.loss_tokens):
            yield from self._close([(key, start, tokens)])
            return
        if self.n == WINDOW:
            yield from self._place()
        self.need[self.n] = (tokens, 1, loss)
        self.keys[self.n] = (key, start)
        self.n += 1

    def _remove(self, i: int) -> None:
        self.n -= 1
        self.need[i], self.keys[i] = self.need[self.n], self.keys[self.n]

    def _place(self) -> Iterator[tuple]:
        """Move one waiting example, or a cut of it, into the open sequence."""
        while True:
            need = self.need[:self.n]
            weight = (need / self.cap) @ (self.left / self.cap)
            fits = (need <= self.left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, weight, -1.0)))
                key, start = self.keys[i]
                self.open.append((key, start, int(need[i, 0])))
                self.left -= need[i]
                self._remove(i)
                if not self.left[:2].all():
                    yield from self._flush()
                return
            room = int(min(self.left[0], self.left[2]))
            if self.cut and self.left[1] >= 1 and room > 0:
                i = int(np.argmax(weight))
                key, start = self.keys[i]
                self.open.append((key, start, room))
                self.keys[i] = (key, start + room)
                self.need[i, 0] -= room
                self.need[i, 2] -= room
            yield from self._flush()

    def _flush(self) -> Iterator[tuple]:
        if self.open:
            pieces, self.open = self.open, []
            self.left = self.cap.copy()
            yield from self._close(pieces)

    def _close(self, pieces: list) -> Iterator[tuple]:
        at, seq, self.next_id = 0, self.next_id, self.next_id + 1
        for key, start, tokens in pieces:
            yield key, start, tokens, seq, at
            at += tokens

    def finish(self) -> Iterator[tuple]:
        """Place what waits; with ``cut`` the last sequence is divided into
        sequences of a power of two each, which need no padding."""
        while self.n:
            yield from self._place()
        if not self.cut:
            yield from self._flush()
            return
        pieces, self.open = self.open, []
        self.left = self.cap.copy()
        total = sum(p[2] for p in pieces)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            part = []
            while room:
                key, start, tokens = pieces.pop(0)
                take = min(room, tokens)
                part.append((key, start, take))
                if take < tokens:
                    pieces.insert(0, (key, start + take, tokens - take))
                room -= take
            yield from self._close(part)


def _first_id() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << _PARTITION_SHIFT


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str | None = None,
                  limits: Limits = Limits()) -> DataFrame:
    """Place whole examples of known size (instruction data, never cut).

    Returns (``id_col``, sequence_id, offset, length). An example beyond a
    capacity gets a sequence of its own. Null or negative sizes count as 0
    and such empty examples are placed nowhere (no row).
    """
    def size(col):
        return F.greatest(F.coalesce(F.col(col).cast("long"), F.lit(0)), F.lit(0))

    id_type = examples.schema[id_col].dataType.simpleString()
    sized = examples.select(F.col(id_col).alias("id"), size(tokens_col).alias("tokens"),
                            size(loss_col or tokens_col).alias("loss"))

    def place(batches):
        packer = Packer(limits, False, _first_id())

        def table(rows, kind):
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), pa.array(cols[3], pa.int64()),
                 pa.array(cols[4], pa.int64()), pa.array(cols[2], pa.int64())],
                names=["id", "sequence_id", "offset", "length"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            rows = []
            for key, tokens, loss in zip(*(batch.column(c).to_pylist()
                                           for c in ("id", "tokens", "loss"))):
                rows += packer.add(key, 0, tokens, loss)
            yield table(rows, kind)
        if kind is not None:
            yield table(list(packer.finish()), kind)

    out = sized.mapInArrow(place, f"id {id_type}, sequence_id long, offset long, length long")
    return out.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", end_id: int = 1,
                   limits: Limits = Limits()) -> DataFrame:
    """Tokenise whole texts, end each with ``end_id``, and pack them with cuts.

    One row per piece: ``id_col``, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. Every token of a
    document is loss-bearing. A sequence is full unless the segment limit
    closed it; what remains at the end of a partition goes into sequences of
    a power of two.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches):
        encode = encoder(tokenizer_path).encode
        packer = Packer(limits, True, _first_id())
        kind, rows, held = None, [], 0

        def table():
            cols = list(zip(*rows))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=names)

        def keep(pieces):
            nonlocal held
            for (doc, ids), start, n, seq, at in pieces:
                held += 4 * n
                rows.append((doc, start, n, ids[4 * start:4 * (start + n)], len(ids) // 4, seq, at))

        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py()) + end
                keep(packer.add((doc, ids), 0, len(ids) // 4, len(ids) // 4))
                if held > 4 << 20:
                    yield table()
                    rows, held = [], 0
        if kind is not None:
            keep(packer.finish())
            if rows:
                yield table()

    out = rows.mapInArrow(pack, f"id {id_type}, start long, length long, ids binary, "
                                "doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
