"""Alignment of two tokenizers' tokens over whole texts, by merge-path partitioning.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (a
SentencePiece model, which adds the space) reads the text. Both spell the same bytes, so the
sorted byte offsets at which their tokens end can be merged: the merge path
of the two lists passes through every pair of overlapping tokens, and an offset in both
lists ends a group. The path is cut into pieces of equal work: for
each evenly spaced diagonal a binary search finds how many of its elements
come from A. The pieces depend on nothing else and walk side by side as one array; each
emits the pairs it passes and the common ends it meets, and running numbers of
common ends over the pieces stitch the groups that reach over a border.

Distributed steps: tasks tokenise and align blocks of documents (several short
ones or one long one) and write, a row a block, the block's distinct pairs with their
numbers and the documents' links as indexes into them. Spark sums the numbers of the
pairs, which tasks have summed before. The most frequent pairs (at most
``Settings.looked_up``, by a cut on the number) go to the tasks that sum up
documents; links of rarer pairs are joined with the table of counts and added.

Defined results: null and empty texts, and texts whose tokens do not spell space + text
in both, have no tokens (zeros, empty digest). Repeated rows count as often as they
occur. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_ROWS, resident, text_or_empty, written
from .tokens import Generations, encoder

MARK = "▁"
AMISS = b"?"  # no whole number of ids


@dataclass(frozen=True)
class Settings:
    block: int = 1 << 18  # characters of a block of documents (a longer text is a block of its own)
    piece: int = 128  # steps of the merge path in one piece
    looked_up: int = 1 << 20  # pairs sent to every task, at most (17 bytes each)


class ByteLevel:
    """Tokenizer A: ids of space + text, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        tok = self.encoder.tok
        byte = {c: b for b, c in self.encoder.letters.items()}
        vocabulary = tok.get_vocab(with_added_tokens=False)
        self.raw = [b""] * (max(vocabulary.values(), default=0) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) \
                else token.encode()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(" " + text), "<u4")


class Pieces:
    """Tokenizer B: ids of a text, word by word where no piece reaches over a space."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
                    else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.words = Generations(lambda w: self._packed(w, self.model.encode(w)))

    def _spells(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.raw.__getitem__, ids)) == b" " + text.encode("utf-8", "surrogatepass")

    def _packed(self, text: str, ids: list[int]) -> bytes:
        """Ids as unsigned 32-bit; ``AMISS`` where they do not spell a space and the text."""
        return array("I", ids).tobytes() if self._spells(ids, text) else AMISS

    def _in_words(self, text: str) -> bool:
        """Whether its words can be encoded one by one: every space begins a word."""
        return self.apart and not ("  " in text or MARK in text or text[:1] == " " or text[-1:] == " ")

    def learn(self, texts) -> None:
        """Encode the new words of these texts in one call of the library."""
        words = {w for t in texts if t and self._in_words(t) for w in t.split(" ")}
        new = self.words.unknown(words)
        for w, ids in zip(new, self.model.encode(new, num_threads=1) if new else []):
            self.words.add(w, self._packed(w, ids))

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of a text; None where they do not spell a space and the text."""
        if self._in_words(text):
            found = list(map(self.words.__getitem__, text.split(" ")))
            return None if AMISS in found else np.frombuffer(b"".join(found), "<u4")
        ids = self.model.encode(text)
        return np.array(ids, "<u4") if self._spells(ids, text) else None


class Aligner:
    """Both tokenizers and the decimal spelling of their ids."""

    def __init__(self, path_a: str, path_b: str, settings: Settings):
        self.a, self.b, self.settings = ByteLevel(path_a), Pieces(path_b), settings
        self.size = [np.array([len(r) for r in t.raw], np.int64) for t in (self.a, self.b)]
        self.many_b = len(self.b.raw)
        # spelled[separator][id], in the order: A "," A "|" B "," B ";"
        spelled = [f"{i}{s}" for t, ends in ((self.a, ",|"), (self.b, ",;")) for s in ends
                   for i in range(len(t.raw))]
        self.spelled = np.array(spelled, "S")
        self.letters = np.char.str_len(self.spelled)
        self.first = np.cumsum([0, len(self.a.raw), len(self.a.raw), self.many_b])

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and by B; none where they do not spell space + text."""
        none = np.zeros(0, np.uint32)
        if not text:
            return none, none
        whole = b" " + text.encode("utf-8", "surrogatepass")
        a, b = self.a.encode(text), self.b.encode(text)
        if b is None or b"".join(map(self.a.raw.__getitem__, a.tolist())) != whole:
            return none, none
        return a, b

    def aligned(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Numbers and digests per text, and the pair (A id x size of B + B id) of every link in order."""
        self.b.learn(texts)
        ids_a, ids_b = zip(*map(self.tokens, texts))
        upto_a, upto_b = (np.cumsum([len(i) for i in ids]) for ids in (ids_a, ids_b))
        a, b = (np.concatenate(ids).astype(np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        i, j, last_a, last_b = merge(ends_a, ends_b, self.settings.piece)
        cut_a, cut_b = last_a + 1, last_b + 1  # tokens up to the end of each group

        # every token at its place among the groups, with the separator behind it
        group_a = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=0))
        group_b = np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=0))
        before_b = np.concatenate([[0], cut_b])
        code = np.zeros(len(a) + len(b), np.int64)
        ends = np.zeros(len(a), bool)
        ends[last_a] = True
        code[np.arange(len(a)) + before_b[group_a]] = np.where(ends, self.first[1], self.first[0]) + a
        ends = np.zeros(len(b), bool)
        ends[last_b] = True
        code[np.arange(len(b)) + cut_a[group_b]] = np.where(ends, self.first[3], self.first[2]) + b
        text = self.spelled[code].tobytes().replace(b"\0", b"")
        chars = np.concatenate([[0], np.cumsum(self.letters[code])])
        at = chars[np.concatenate([[0], upto_a + upto_b])].tolist()
        digests = [hashlib.sha256(text[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(at, at[1:])]
        links = np.searchsorted(i, upto_a)
        return {"n_a": np.diff(upto_a, prepend=0), "n_b": np.diff(upto_b, prepend=0),
                "n_groups": np.diff(np.searchsorted(cut_a, upto_a, "right"), prepend=0),
                "n_links": np.diff(links, prepend=0), "groups_sha256": digests,
                "pairs": a[i] * self.many_b + b[j]}


def diagonals(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` elements of the merge of ``a`` and ``b`` (equal ones: ``a`` first) are from ``a``."""
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.flatnonzero(open_)
        m = mid[at]
        more = a[m] <= b[d[at] - 1 - m]
        low[at[more]] = m[more] + 1
        high[at[~more]] = m[~more]
    return low


def merge(a: np.ndarray, b: np.ndarray, piece: int):
    """Links (i, j) of the overlapping tokens that end at ``a[i]`` and ``b[j]``, in
    order, and the tokens (i of a, j of b) that end together. Both lists end alike."""
    none = np.zeros(0, np.int64)
    if not len(a):
        return none, none, none, none
    steps = len(a) + len(b)
    start = np.arange(0, steps, piece)
    i = diagonals(a, b, start)
    j = start - i
    tall = np.append(a, np.iinfo(np.int64).max)
    wide = np.append(b, np.iinfo(np.int64).max)
    path = np.empty((2, piece, len(start)), np.int64)
    for step in range(piece):  # all pieces walk one step; a walk stays at the corner when it is there
        path[0, step], path[1, step] = i, j
        from_a = tall[i] <= wide[j]
        i = np.minimum(i + from_a, len(a))
        j = np.minimum(j + ~from_a, len(b))
    i, j = path.transpose(0, 2, 1).reshape(2, -1)[:, :steps]
    # a state whose A end has just been passed and is B's end too: a common end, no link
    common = (i > 0) & (a[i - 1] == wide[j])
    return i[~common], j[~common], i[common] - 1, j[common]


def _blocks(batches, limit: int):
    """(ids, texts) of documents in order, cut at ``limit`` characters."""
    ids, texts, held, kind = [], [], 0, None
    for batch in batches:
        kind = batch.schema.field("_id").type
        for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
            text = text.as_py()
            if texts and held + len(text or "") > limit:
                yield pa.array(ids, kind), texts
                ids, texts, held = [], [], 0
            ids.append(key)
            texts.append(text)
            held += len(text or "")
    if texts:
        yield pa.array(ids, kind), texts


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str,
                 settings: Settings) -> DataFrame:
    """One row per block of documents: block, lists per document (ids, numbers,
    digests), pairs and counts (binary, 64 and 32-bit: the distinct pairs, most frequent first)
    and links (binary, 32-bit: indexes into pairs, document after document)."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def align(batches):
        aligner = resident(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b, settings))
        base = TaskContext.get().partitionId() << 32
        for number, (ids, texts) in enumerate(_blocks(batches, settings.block)):
            found = aligner.aligned(texts)
            pairs, links, counts = np.unique(found["pairs"], return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            lists = [pa.array([found[c].tolist()], pa.list_(pa.int64())) for c in NUMBERS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + number], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *lists,
                 pa.array([found["groups_sha256"]], pa.list_(pa.string())),
                 pa.array([pairs[order].astype("<i8").tobytes()], pa.binary()),
                 pa.array([counts[order].astype("<u4").tobytes()], pa.binary()),
                 pa.array([place[links].tobytes()], pa.binary())],
                names=["block", "ids", *NUMBERS, "groups_sha256", "pairs", "counts", "links"])

    return rows.mapInArrow(align, f"block long, ids array<{kind}>, "
                           + ", ".join(f"{c} array<long>" for c in NUMBERS)
                           + ", groups_sha256 array<string>, pairs binary, counts binary, links binary")


def _read(column, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind) if len(column[row].as_buffer()) else np.zeros(0, kind)


def pair_counts(blocks: DataFrame, many_b: int, held: int = 1 << 22) -> DataFrame:
    """pair, n (links of the whole corpus that hold it) and best (no pair of its B id has more)."""
    def add(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        more, size = [], 0

        def summed():
            keys, at = np.unique(np.concatenate([pairs, *(p for p, _ in more)]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([counts, *(c for _, c in more)]))
            return keys, total

        def table():
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                more.append((_read(batch.column("pairs"), row, "<i8"),
                             _read(batch.column("counts"), row, "<u4")))
                size += len(more[-1][0])
                if size > held:
                    pairs, counts = summed()
                    more, size = [], 0
                    if len(pairs) > held:
                        yield table()
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = summed()
        if len(pairs):
            yield table()

    counts = (blocks.select("pairs", "counts").mapInArrow(add, "pair long, n long")
              .groupBy("pair").agg(F.sum("n").alias("n")))
    counts, _ = written(counts.select("pair", "n", (F.col("pair") % many_b).cast("int").alias("b")))
    # one row per entry of B's vocabulary, at most
    highest = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _cut(counts: DataFrame, most: int) -> tuple[int, int]:
    """The smallest number of links such that at most ``most`` pairs have as many, and
    the number of pairs below it. Read from at most 64 x 64 rows of a histogram."""
    log = F.log2("n")
    steps = (counts.groupBy(F.floor(log * 64).alias("step"))
             .agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least"))
             .orderBy(F.col("step").desc()).collect())
    cut, held = 1 << 62, 0
    for s in steps:
        if held + s.pairs > most:
            break
        cut, held = s.least, held + s.pairs
    return cut, sum(s.pairs for s in steps) - held


def sum_documents(blocks: DataFrame, counts: DataFrame, settings: Settings) -> DataFrame:
    """One row per document: _id, the numbers, n_best, count_sum and groups_sha256."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    cut, rarer = _cut(counts, settings.looked_up)
    top = counts.where(F.col("n") >= cut).orderBy("pair").toArrow()
    table = blocks.sparkSession.sparkContext.broadcast(
        tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))

    def looked_up(pairs):
        keys, n, best = table.value
        at = np.searchsorted(keys, pairs)
        known = at < len(keys)
        known[known] = keys[at[known]] == pairs[known]
        at = at[known]
        values = np.zeros((2, len(pairs)), np.int64)
        values[:, known] = best[at], n[at]
        return known, values

    def sums(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _, (best, n) = looked_up(_read(batch.column("pairs"), row, "<i8"))
                links = _read(batch.column("links"), row, "<u4")
                numbers = [batch.column(c)[row].values for c in NUMBERS]
                upto = np.concatenate([[0], np.cumsum(numbers[3].to_numpy())])
                totals = [np.diff(np.concatenate([[0], np.cumsum(v[links])])[upto]) for v in (best, n)]
                ids = batch.column("ids")[row].values
                block = batch.column("block")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int64)), ids,
                     *numbers, *map(pa.array, totals), batch.column("groups_sha256")[row].values],
                    names=["block", "place", "_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    out = blocks.drop("counts").mapInArrow(
        sums, f"block long, place long, _id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS)
        + ", n_best long, count_sum long, groups_sha256 string")
    if not rarer:
        return out.drop("block", "place")

    def rare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                pairs = _read(batch.column("pairs"), row, "<i8")
                known, _ = looked_up(pairs)
                links = _read(batch.column("links"), row, "<u4")
                per_doc = batch.column("n_links")[row].values.to_numpy()
                doc = np.repeat(np.arange(len(per_doc)), per_doc)
                at = np.flatnonzero(~known[links])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), batch.column("block")[row].as_py())),
                     pa.array(doc[at].astype(np.int64)), pa.array(pairs[links[at]])],
                    names=["block", "place", "pair"])

    # a rare pair has fewer links than any looked-up one, so no key here is hot
    more = (blocks.select("block", "n_links", "pairs", "links")
            .mapInArrow(rare, "block long, place long, pair long")
            .groupBy("block", "place", "pair").agg(F.count(F.lit(1)).alias("links"))
            .join(counts.where(F.col("n") < cut), "pair")
            .groupBy("block", "place")
            .agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("_best"),
                 F.sum(F.col("links") * F.col("n")).alias("_n")))
    return (out.join(more, ["block", "place"], "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
                          "count_sum": F.col("count_sum") + F.coalesce("_n", F.lit(0))})
            .drop("block", "place", "_best", "_n"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                    text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece
    many_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks, _ = written(align_blocks(docs, path_a, path_b, id_col, text_col, settings), **LARGE_ROWS)
    counts, _ = written(pair_counts(blocks, many_b))
    return sum_documents(blocks, counts, settings).withColumnRenamed("_id", id_col)
