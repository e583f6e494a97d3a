"""Token-id files of patched frame-of-reference blocks.

File layout (all integers little-endian). A file is a row of groups, an
index and a footer, each followed by one line feed:

* group: up to ``GROUP`` blocks of ``BLOCK`` ids (the last block of a file may be shorter).
  Per block a 16-byte head (minimum u32, width u32, exceptions u32, ids u32),
  then per block its packed words and its exceptions. A block stores ``id - minimum`` in ``width`` bits;
  ``width`` covers the percentile of the block's values that makes the
  block smallest, and values beyond it are exceptions: position u16 list,
  then the bits above ``width`` as u32 list.
* index: byte offset u64 of each block's head, byte offset u64 of its words, then per document
  doc id i64, null flag u8 and number of ids u64 (each as a list).
* footer: magic, part number, blocks, documents, ids, index offset (u64 each).

Packed words: a block is 32 rows of ``BLOCK / 32`` lanes; each lane holds 32
values of ``width`` bits in ``width`` 32-bit words, so packing and unpacking
are a few shifts over all blocks of one width.

Documents are range-partitioned by id (one shuffle of the texts), sorted and
encoded where they land, and written through Spark's own text sink, whose
commit protocol drops the output of failed tasks; any file system that Spark
writes to will do. Each file is bounded by ``chars_per_file``, so reading one
file in one task is bounded too (a longer file only arises from one document).

Defined results: null text is empty (its only id is the end id); null doc ids
come first; repeated ids keep all rows (in order of text); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import TOGETHER, encoder

MAGIC = 0x31304B4C42524650
BLOCK = 1024
LANES = BLOCK // 32
GROUP = 256
PERCENTILES = (0.90, 0.95, 0.98, 1.0)
CHARS_PER_FILE = 24_000_000
_FOOTER = struct.Struct("<6Q")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width -> (blocks, width * LANES) words."""
    rows = values.reshape(-1, 32, LANES).astype(np.uint64)
    out = np.zeros((len(rows), width + 1, LANES), np.uint64)
    for r in range(32):
        word, shift = divmod(r * width, 32)
        part = rows[:, r] << np.uint64(shift)
        out[:, word] |= part & np.uint64(0xFFFFFFFF)
        out[:, word + 1 if word < width else word] |= part >> np.uint64(32)
    return out[:, :width].astype("<u4").reshape(len(rows), width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = words.reshape(-1, width, LANES).astype(np.uint64)
    out = np.zeros((len(rows), 32, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for r in range(32):
        word, shift = divmod(r * width, 32)
        part = rows[:, word] >> np.uint64(shift)
        if shift + width > 32:
            part = part | (rows[:, word + 1] << np.uint64(32 - shift))
        out[:, r] = part & mask
    return out.reshape(len(rows), BLOCK)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def encode_group(ids: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """Bytes of one group, and the offsets of its blocks' heads and words."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.int64)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    bits = _bits(delta)
    counts = np.bincount((np.arange(blocks)[:, None] * 33 + bits).ravel(), minlength=blocks * 33)
    reach = counts.reshape(blocks, 33).cumsum(axis=1)
    best = np.full(blocks, 1 << 60)
    width = np.zeros(blocks, np.int64)
    for share in PERCENTILES:
        w = (reach >= np.ceil(share * BLOCK)).argmax(axis=1)
        beyond = BLOCK - reach[np.arange(blocks), w]
        cost = w * BLOCK + beyond * 48
        width = np.where(cost < best, w, width)
        best = np.minimum(cost, best)
    over = bits > width[:, None]
    words: list = [b""] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            packed = _pack(delta[at] & ((1 << int(w)) - 1), int(w))
            for b, row in zip(at, packed):
                words[b] = row.tobytes()
    head, body, starts = [], [], []
    size = 16 * blocks
    for b in range(blocks):
        pos = np.flatnonzero(over[b])
        high = delta[b, pos] >> width[b]
        head.append(struct.pack("<4I", low[b], width[b], len(pos), min(BLOCK, n - b * BLOCK)))
        data = words[b] + pos.astype("<u2").tobytes() + high.astype("<u4").tobytes()
        starts.append(size)
        size += len(data)
        body.append(data)
    return b"".join(head + body), [16 * b for b in range(blocks)], starts


def decode_blocks(content: bytes, heads: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks whose heads and words lie at these byte offsets."""
    meta = np.array([struct.unpack_from("<4I", content, int(h)) for h in heads],
                    np.int64).reshape(-1, 4)
    grid = np.zeros((len(meta), BLOCK), np.int64)
    for w in np.unique(meta[:, 1]):
        if w:
            at = np.flatnonzero(meta[:, 1] == w)
            size = int(w) * LANES
            words = np.stack([np.frombuffer(content, "<u4", size, int(starts[b])) for b in at])
            grid[at] = _unpack(words, int(w)).astype(np.int64)
    for b in np.flatnonzero(meta[:, 2]):
        k = int(meta[b, 2])
        at = int(starts[b]) + int(meta[b, 1]) * LANES * 4
        pos = np.frombuffer(content, "<u2", k, at)
        grid[b, pos] += np.frombuffer(content, "<u4", k, at + 2 * k).astype(np.int64) << meta[b, 1]
    grid += meta[:, :1]
    if len(meta) and (meta[:, 3] == BLOCK).all():
        return grid.ravel().astype("<u4")
    return np.concatenate([g[:k] for g, k in zip(grid, meta[:, 3])] or [grid.ravel()]).astype("<u4")


class FileWriter:
    """Streams the rows (byte strings) of one file."""

    def __init__(self, part: int):
        self.part, self.at, self.total = part, 0, 0
        self.heads, self.starts, self.docs = [], [], []
        self.buffer = bytearray()

    def _group(self, size: int) -> bytes:
        data, heads, starts = encode_group(np.frombuffer(bytes(self.buffer[:4 * size]), "<u4"))
        del self.buffer[:4 * size]
        self.heads += [self.at + h for h in heads]
        self.starts += [self.at + s for s in starts]
        self.at += len(data) + 1
        return data

    def add(self, doc_id, ids: bytes):
        self.docs.append((doc_id, len(ids) // 4))
        self.total += len(ids) // 4
        self.buffer += ids
        while len(self.buffer) >= 4 * BLOCK * GROUP:
            yield self._group(BLOCK * GROUP)

    def finish(self):
        if self.buffer:
            yield self._group(len(self.buffer) // 4)
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        null = np.array([d is None for d, _ in self.docs], "u1")
        size = np.array([n for _, n in self.docs], "<u8")
        index = b"".join(a.tobytes() for a in (np.array(self.heads, "<u8"),
                                               np.array(self.starts, "<u8"), ids, null, size))
        yield index
        yield _FOOTER.pack(MAGIC, self.part, len(self.heads), len(self.docs), self.total, self.at)


class FileReader:
    """Footer and index of one file; ids by block range."""

    def __init__(self, content: bytes):
        self.content = content
        end = len(content) - 1 - _FOOTER.size
        magic, self.part, blocks, docs, self.total, at = _FOOTER.unpack_from(content, end)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.heads = np.frombuffer(content, "<u8", blocks, at)
        self.starts = np.frombuffer(content, "<u8", blocks, at + 8 * blocks)
        at += 16 * blocks
        ids = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, "u1", docs, at + 8 * docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.sizes = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file; only the blocks that hold them are decoded."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        ids = decode_blocks(self.content, self.heads[first:last], self.starts[first:last])
        return ids[start - first * BLOCK:stop - first * BLOCK]

    def documents(self):
        """(doc_id, start in the file, ids) in file order, a bounded group of blocks at a time."""
        ends = self.sizes.cumsum()
        held, base, have = np.empty(0, "<u4"), 0, 0
        for doc, end, size in zip(self.doc_ids, ends, self.sizes):
            end, size = int(end), int(size)
            while have < end:
                stop = min(self.total, have + BLOCK * GROUP)
                held = np.concatenate([held[end - size - base:], self.read(have, stop)])
                base, have = end - size, stop
            yield doc, end - size, held[end - size - base:end - base]


def write_documents(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                    text_col: str = "text", end_id: int = 2,
                    chars_per_file: int = CHARS_PER_FILE) -> None:
    """Encode whole texts, end each with ``end_id``, and write the files in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       text_or_empty(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    files = 1 + int(chars // chars_per_file)
    ordered = (rows.repartitionByRange(files, F.col("id").asc_nulls_first())
               .sortWithinPartitions(F.col("id").asc_nulls_first(), "text"))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        writer = None
        schema = pa.schema([("value", pa.binary())])
        table = encoder(tokenizer_path)

        def blocks(batch):
            """Lists of documents of about ``TOGETHER`` characters, in order."""
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > TOGETHER:
                    yield ids, texts
                    ids, texts, held = [], [], 0
            yield ids, texts

        for batch in batches:
            writer = writer or FileWriter(TaskContext.get().partitionId())
            for ids, texts in blocks(batch):
                for doc, raw in zip(ids, table.encode_many(texts)):
                    for data in writer.add(doc, raw + end):
                        yield pa.RecordBatch.from_arrays([pa.array([data])], schema=schema)
        if writer:
            for data in writer.finish():
                yield pa.RecordBatch.from_arrays([pa.array([data])], schema=schema)

    # the text sink writes the bytes of a row as they are, and a line feed
    (ordered.mapInArrow(encode, "value binary")
     .select(F.col("value").cast("string").alias("value")).write.mode("overwrite").text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    # an empty table leaves files without a byte: no footer, no document
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id",
                   with_ids: bool = True) -> DataFrame:
    """Read the files back: ``id_col``, start (ids of all documents before),
    n_tokens, ids_crc32 and, with ``with_ids``, ids (binary, u32).

    The files' totals (one row a file) are summed in file order to place each
    file; documents are decoded file by file where they lie.
    """
    def totals(batches):
        for batch in batches:
            for content in batch.column("content"):
                r = FileReader(content.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_pydict({"part": [r.part], "total": [r.total]})

    def documents(batches):
        kinds = [("part", pa.int64()), ("id", pa.int64()), ("at", pa.int64()),
                 ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        kinds += [("ids", pa.binary())] * with_ids
        for batch in batches:
            for content in batch.column("content"):
                r = FileReader(content.as_buffer().to_pybytes())
                out, held = [], 0
                for doc, start, ids in r.documents():
                    raw = ids.tobytes()
                    out.append((r.part, doc, start, len(ids), zlib.crc32(raw), raw)[:len(kinds)])
                    held += 64 + len(raw) * with_ids
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)],
                            schema=pa.schema(kinds))
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)],
                        schema=pa.schema(kinds))

    files = _files(spark, path)
    sums = files.mapInArrow(totals, "part long, total long")  # one row a file
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part"))
                                  - F.col("total")).alias("before"))
    rows = files.mapInArrow(documents, "part long, id long, at long, n_tokens long, "
                                       "ids_crc32 long" + ", ids binary" * with_ids)
    out = rows.join(before, "part").select(
        F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"),
        "n_tokens", "ids_crc32", *(["ids"] * with_ids))
    return out
