"""SentencePiece encoding and decoding as a max-plus parallel scan.

The best segmentation of a text into pieces is a longest path, and longest
paths compose: for a chunk of text, ``T[e][x]`` is the best score of the
pieces that start in the chunk, when the piece across its left boundary
reaches ``e`` characters into it and its own last piece reaches ``x``
characters beyond it. The matrix of two neighbouring chunks is the max-plus
product of theirs, in any order of combination. So giant documents are split
into chunks of ``CHUNK`` characters that yield their matrices independently; matrices are
combined ``FAN`` at a time, level by level; the boundary states are resolved
back down the same levels; and each chunk is traced back on its own between its two states.

Pieces hold the space mark only at their start (``Vocabulary`` checks it),
so every best path has a boundary before a space mark that follows another
character. Inside a chunk that makes the matrix a vector of heads, the sum
of the words' best scores and a vector of tails; words repeat, so each
worker keeps a bounded table of word segmentations. The words of many texts that
are not in it are segmented in one call: no piece reaches over a break, so the best path of a
row of words is made of the words' own (``Vocabulary.learn``).

Scores are integers, so sums do not depend on the order of combination. The
public model file is of the BPE kind, which has merge ranks for scores; the
named method needs unigram scores, so a piece scores ``-log(rank + 2)`` in
fixed point, with a small amount per piece against ties; paths with the same pieces in
another order still tie, and among those the choice may depend on the chunk
boundaries. Characters without a piece become their bytes.

Defined results: null text is empty (no tokens, one chunk); repeated rows are encoded
each; null ids are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_ROWS, text_or_empty, written
from .jaccard_join import runs_of
from .tokens import KEPT_LENGTH, Generations

MARK = "▁"
CHUNK = 32_768
FAN = 64
WORDS = 200_000  # entries of a worker's word table (memory bound, not a limit on words)
TOGETHER = 1 << 18  # characters of texts whose words are learned in one call
NEVER = -(1 << 60)
_WORD = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
_BREAK = re.compile(f"(?<=[^{MARK}]){MARK}")


class Vocabulary:
    """Pieces of a SentencePiece model with fixed-point unigram scores."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_unknown(i) or model.is_control(i) or model.is_unused(i)
                   for i in range(len(self.pieces))]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.plain = {p: i for i, p in enumerate(self.pieces)
                      if not special[i] and not model.is_byte(i)}
        value = {i: bytes([v]) for v, i in self.byte.items()}
        self.raw = [value.get(i, p.encode()) for i, p in enumerate(self.pieces)]
        if any(MARK in p.lstrip(MARK) for p in self.plain):
            raise ValueError("pieces must hold the space mark only at their start")
        first = min(self.plain.values())
        self.score = {p: piece_score(i - first) for p, i in self.plain.items()}
        self.unknown = min(self.score.values()) - (10 << 24)
        self.longest = max(map(len, self.plain))
        self.forget()

    def forget(self) -> None:
        """Empty the tables that only segmentation needs; they fill again on use."""
        for name in ("steps", "_row"):
            self.__dict__.pop(name, None)
        # marked word -> (ids, score): the words that ``learn`` leaves out
        self.words = Generations(lambda w: self.path(w, 0, len(w), len(w)), WORDS // 64)
        # word without its first mark -> ids; two generations bound the table, so once-only words leave it
        self.found = Generations(lambda w: self.words[MARK + w][0], WORDS // 2)

    @cached_property
    def steps(self) -> dict:
        """Scores, and 1 for what only begins a piece."""
        return {p[:k]: 1 for p in self.score for k in range(1, len(p))} | self.score

    def edges(self, s: str, i: int, stop: int):
        """(end, score) of the pieces that start at ``i`` and end by ``stop``."""
        single = False
        for j in range(i + 1, min(i + self.longest, stop) + 1):
            score = self.score.get(s[i:j])
            if score is not None:
                single |= j == i + 1
                yield j, score
        if not single and i < stop:
            yield i + 1, self.unknown

    def forward(self, s: str, start: int, limit: int, stop: int):
        """Best score to each position from ``start``; pieces start before
        ``limit`` and end by ``stop``. Also the start of the last piece."""
        best, back = [NEVER] * (stop - start + 1), [0] * (stop - start + 1)
        best[0] = 0
        steps, longest, unknown = self.steps, self.longest, self.unknown
        for i in range(start, limit):
            here = best[i - start]
            if here == NEVER:
                continue
            single = False
            for j in range(i + 1, min(i + longest, stop) + 1):
                score = steps.get(s[i:j], 2)
                if score == 2:  # no piece begins like this
                    break
                if score <= 0:
                    single |= j == i + 1
                    if here + score > best[j - start]:
                        best[j - start], back[j - start] = here + score, i
            if not single and here + unknown > best[i + 1 - start]:
                best[i + 1 - start], back[i + 1 - start] = here + unknown, i
        return best, back

    def path(self, s: str, start: int, limit: int, stop: int) -> tuple[bytes, int]:
        """Ids (unsigned 32-bit) and score of the best path from ``start`` to ``stop``."""
        best, back = self.forward(s, start, limit, stop)
        cuts = [stop]
        while cuts[-1] > start:
            cuts.append(back[cuts[-1] - start])
        cuts.reverse()
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            i = self.plain.get(s[a:b])
            if i is None:
                ids += [self.byte[x] for x in s[a:b].encode("utf-8", "surrogatepass")]
            else:
                ids.append(i)
        return array("I", ids).tobytes(), best[stop - start]

    @cached_property
    def _row(self):
        """For a row of words: the ``tokenizers`` model with these pieces and scores, its tokens' ids and
        characters, a character that stands for each one that is no piece, and which ones those are.

        It adds up doubles; scores are below 2**53 with 24 bits after the point, so its sums are
        exact, and of paths that tie it takes the same one as ``forward``.
        """
        from tokenizers import Tokenizer
        from tokenizers.models import Unigram
        used = set().union(*self.plain)
        stand_in, never = [chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in used][:2]
        names = [*self.plain, stand_in, never]  # the last is the model's unknown piece, which rows do not hold
        scores = [*(self.score[p] for p in self.plain), self.unknown, self.unknown]
        model = Unigram([(p, s / (1 << 24)) for p, s in zip(names, scores)], len(names) - 1, False)
        known = {c for c in used if c in self.plain}

        def any_of(chars, but=""):
            return re.compile(f"[{but}{''.join(map(re.escape, sorted(chars)))}]")

        return (Tokenizer(model), np.array([*self.plain.values(), 0, 0], "<u4"),
                np.array([len(p) for p in names]), stand_in, any_of(known, "^"),
                any_of(used - known) if used > known else None)

    def learn(self, words) -> None:
        """Segment those of the words (without their first mark) that are in no table, together."""
        before = self.found.turns
        self._learn(words)
        if self.found.turns > before:  # some of them may have left the table
            self._learn(words)

    def _learn(self, words) -> None:
        library, numbers, letters, stand_in, odd_ones, alone = self._row
        new = [w for w in self.found.unknown(words)
               if w and w[-1] != MARK and len(w) <= KEPT_LENGTH]  # marks alone would join the next word
        if alone is not None:  # characters in pieces, but none by itself
            new = [w for w in new if alone.search(w) is None]
        if not new:
            return
        text = MARK + MARK.join(new)
        tokens = np.array(library.encode(odd_ones.sub(stand_in, text), add_special_tokens=False).ids)
        ends = letters[tokens].cumsum()
        stops = np.searchsorted(ends, np.cumsum([len(w) + 1 for w in new])) + 1
        ids = numbers[tokens]
        strange = tokens == len(self.plain)
        if strange.any():  # each becomes the bytes of its character
            chars = "".join([text[e - 1] for e in ends[strange].tolist()])
            points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = np.ones(len(tokens), np.int64)
            sizes[strange] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            ids = np.repeat(ids, sizes)
            raw = np.frombuffer(chars.encode("utf-8", "surrogatepass"), np.uint8)
            ids[np.repeat(strange, sizes)] = self._bytes[raw]
            stops = sizes.cumsum()[stops - 1]
        raw, stops = ids.tobytes(), (4 * stops).tolist()
        self.found.add_all(new, [raw[a:b] for a, b in zip([0, *stops], stops)])

    def row(self, words: list[str]) -> bytes:
        """Ids of words (without their first mark) in turn."""
        return b"".join(map(self.found.__getitem__, words))

    @cached_property
    def _bytes(self) -> np.ndarray:
        return np.array([self.byte[x] for x in range(256)], "<u4")

    @cached_property
    def _values(self) -> np.ndarray:
        values = np.zeros(len(self.pieces), np.int64)
        for p, i in self.plain.items():
            values[i] = self.score[p]
        for x, i in self.byte.items():  # a character without a piece counts by its first byte
            values[i] = 0 if 0x80 <= x < 0xC0 else self.unknown
        return values

    def value(self, ids: bytes) -> int:
        """Score of these ids."""
        return int(self._values[np.frombuffer(ids, "<u4")].sum())

    def decode(self, ids: bytes) -> str:
        """Marked text of the ids."""
        raw = b"".join(map(self.raw.__getitem__, array("I", ids)))
        return raw.decode("utf-8", "surrogatepass")


def piece_score(rank: int) -> int:
    """Fixed-point score of the piece of this rank, 24 bits after the point."""
    return -round(log(rank + 2) * (1 << 24)) - (rank * 2654435761 >> 16) % 61


def marked(text: str) -> str:
    """Text with space marks and the leading one; the empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def words_of(text: str) -> list[str]:
    """The words of a text, each without its first mark."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in _WORD.findall(marked(text))]
    return text.split(" ") if text else []


def unmarked(text: str) -> str:
    return text[1:].replace(MARK, " ")


class Chunk:
    """Characters [1, 1 + size) of ``s``; one character before and the look-ahead after are context."""

    def __init__(self, voc: Vocabulary, s: str, size: int):
        self.voc, self.s, self.a, self.b = voc, s, 1, 1 + size
        breaks = [m.start() for m in _BREAK.finditer(s, 0, self.b)]
        breaks = [x for x in breaks if x >= self.a]
        self.first, self.last = (breaks[0], breaks[-1]) if breaks else (None, None)

    def _words(self) -> bytes:
        """Ids of the words between the first and the last break."""
        words = [w[1:] for w in _WORD.findall(self.s[self.first:self.last])]
        self.voc.learn(set(words))
        return self.voc.row(words)

    def matrix(self) -> np.ndarray:
        n = self.voc.longest
        out = np.full((n, n), NEVER, np.int64)
        stop = min(self.b + n - 1, len(self.s))
        if self.first is None:
            for e in range(min(n, self.b - self.a + 1)):
                best, _ = self.voc.forward(self.s, self.a + e, self.b, stop)
                for x in range(stop - self.b + 1):
                    out[e, x] = best[self.b + x - self.a - e]
            return out
        heads = [NEVER] * n  # best from a + e to the first break
        size = self.first - self.a
        back = [NEVER] * (size + 1)
        back[size] = 0
        for i in range(size - 1, -1, -1):
            back[i] = max((score + back[j - self.a] for j, score in
                           self.voc.edges(self.s, self.a + i, self.first)), default=NEVER)
        heads[:min(n, size + 1)] = back[:n]
        body = self.voc.value(self._words())
        best, _ = self.voc.forward(self.s, self.last, self.b, stop)
        for e, h in enumerate(heads):
            for x in range(stop - self.b + 1):
                t = best[self.b + x - self.last]
                if h > NEVER and t > NEVER:
                    out[e, x] = h + body + t
        return out

    def ids(self, e: int, x: int) -> bytes:
        """Ids of the best path from state ``e`` to state ``x``."""
        start, stop = self.a + e, self.b + x
        if self.first is None:
            return self.voc.path(self.s, start, self.b, stop)[0]
        return (self.voc.path(self.s, start, self.first, self.first)[0] + self._words()
                + self.voc.path(self.s, self.last, self.b, stop)[0])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; NEVER stays NEVER."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), NEVER)


def between(matrices: list[np.ndarray], e: int, x: int) -> list[int]:
    """States at the inner boundaries of consecutive chunks on the best path
    that enters the first in ``e`` and leaves the last in ``x``."""
    best = [matrices[0][e]]
    for m in matrices[1:]:
        best.append(np.maximum((best[-1][:, None] + m).max(axis=0), NEVER))
    states = [x]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(best[k - 1] + matrices[k][:, states[-1]])))
    return states[:0:-1]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


# --- distributed steps ---------------------------------------------------------------

def _split(docs: DataFrame, path: str, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """One row per chunk: _row, _id, k, chunks, context (text with its context, for giant texts) and
    matrix; a text of one chunk is encoded at once (ids) as its states are known."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"),
                       F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_row", "_id", "k", "chunks", "context", "matrix", "ids"]

    def split(batches):
        voc = vocabulary(path)
        for batch in batches:
            id_type = batch.schema.field("_id").type
            types = [pa.int64(), id_type, pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
            out, held, waiting, fresh = [], 0, [], 0

            def settle():
                voc.learn(set().union(*(words for _, _, words in waiting)))
                out.extend((row, key, 0, 1, None, None, voc.row(words)) for row, key, words in waiting)
                waiting.clear()

            def table():
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

            for row, key, text in zip(batch.column("_row").to_pylist(),
                                      batch.column("_id").to_pylist(), batch.column("_text")):
                text = text.as_py()
                size = len(text) + 1 if text else 0  # with the first mark
                count = max(1, -(-size // chunk))
                if count > 1 and size - (count - 1) * chunk < voc.longest:
                    count -= 1  # a chunk is never shorter than a piece
                if count == 1:
                    waiting.append((row, key, words_of(text)))
                    fresh += size
                    held += size
                    if fresh > TOGETHER:
                        settle()
                        fresh = 0
                else:
                    s = marked(text)
                    for k in range(count):
                        a, b = k * chunk, (k + 1) * chunk if k < count - 1 else len(s)
                        # before the text stands a mark, so no break is seen at its start
                        context = (s[a - 1] if a else MARK) + s[a:b + voc.longest - 1]
                        part = Chunk(voc, context, b - a)
                        out.append((row, key, k, count, context, part.matrix().tobytes(), None))
                        held += b - a
                if held > 4 << 20 or len(out) > 4096:
                    yield table()
                    out.clear()
                    held = 0
            settle()
            if out:
                yield table()

    return rows.mapInArrow(split, f"_row long, _id {kind}, k int, chunks int, context string, "
                                  "matrix binary, ids binary")


def _sorted_runs(df: DataFrame) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "part").sortWithinPartitions("part", "k")


def _combined(level: DataFrame, size: int) -> DataFrame:
    """Products of FAN consecutive matrices: (_row, k, chunks, matrix) one level up."""
    def combine(batches):
        for rows, ks, counts, raw in runs_of(batches, "part", ["_row", "k", "chunks", "matrix"]):
            total = None
            for r in raw:
                m = np.frombuffer(r, np.int64).reshape(size, size)
                total = m if total is None else product(total, m)
            yield pa.RecordBatch.from_pydict(
                {"_row": pa.array([rows[0]], pa.int64()), "k": pa.array([ks[0] // FAN], pa.int32()),
                 "chunks": pa.array([-(-counts[0] // FAN)], pa.int32()),
                 "matrix": pa.array([total.tobytes()], pa.binary())})

    grouped = level.select("_row", "k", "chunks", "matrix", F.xxhash64(
        "_row", F.floor(F.col("k") / FAN)).alias("part"))
    return _sorted_runs(grouped).mapInArrow(combine, "_row long, k int, chunks int, matrix binary")


def _resolved(level: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """(_row, k, e, x) of a level's chunks from the states of the level above."""
    def resolve(batches):
        for rows, ks, raw, es, xs in runs_of(batches, "part", ["_row", "k", "matrix", "e", "x"]):
            matrices = [np.frombuffer(r, np.int64).reshape(size, size) for r in raw]
            inner = between(matrices, es[0], xs[0])
            yield pa.RecordBatch.from_pydict(
                {"_row": pa.array(rows, pa.int64()), "k": pa.array(ks, pa.int32()),
                 "e": pa.array([es[0], *inner], pa.int32()),
                 "x": pa.array([*inner, xs[0]], pa.int32())})

    grouped = (level.select("_row", "k", "matrix", F.floor(F.col("k") / FAN).cast("int").alias("up"))
               .join(above.withColumnRenamed("k", "up"), ["_row", "up"])
               .withColumn("part", F.xxhash64("_row", "up")))
    return _sorted_runs(grouped).mapInArrow(resolve, "_row long, k int, e int, x int")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of each text: _row, ``id_col``, k, chunks and ids
    (binary, unsigned 32-bit); a text's ids are those of its chunks in order."""
    size = vocabulary(path).longest
    table, _ = written(_split(docs, path, id_col, text_col, chunk), **LARGE_ROWS)
    giant = table.where("chunks > 1")
    levels = [giant.select("_row", "k", "chunks", "matrix")]
    most = giant.agg(F.max("chunks")).first()[0] or 1
    while most > FAN:  # after the last level each text has at most FAN matrices
        up, _ = written(_combined(levels[-1], size))
        levels.append(up)
        most = -(-most // FAN)
    # the whole text is entered and left in state 0
    states = levels[-1].select("_row").distinct().select(
        "_row", F.lit(0).alias("k"), F.lit(0).alias("e"), F.lit(0).alias("x"))
    for level in reversed(levels):
        states = _resolved(level, states, size)

    def trace(batches):
        voc = vocabulary(path)
        for batch in batches:
            ids = [Chunk(voc, c, n).ids(e, x) for c, n, e, x in zip(
                *(batch.column(c).to_pylist() for c in ("context", "size", "e", "x")))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_row", "_id", "k", "chunks")), pa.array(ids, pa.binary())],
                names=["_row", "_id", "k", "chunks", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = F.when(F.col("k") < F.col("chunks") - 1, F.lit(chunk)).otherwise(F.length("context") - 1)
    traced = (giant.join(states, ["_row", "k"])
              .select("_row", "_id", "k", "chunks", "context", own.alias("size"), "e", "x")
              .mapInArrow(trace, f"_row long, _id {kind}, k int, chunks int, ids binary"))
    traced, _ = written(traced, **LARGE_ROWS)  # else a reader's task holds a second Python worker, for these
    return (table.where("chunks = 1").select("_row", "_id", "k", "chunks", "ids")
            .unionByName(traced).withColumnRenamed("_id", id_col))


def decode_chunks(encoded: DataFrame, path: str, sums: bool = False) -> DataFrame:
    """``encoded`` with text: the marked text of each chunk's ids.

    With ``sums`` ids and text do not leave the task; in their place come the bytes and the checksum of
    each (ids_bytes, ids_crc, text_bytes, text_crc) and chars, the text being without its marks.
    """
    kept = encoded.drop("ids") if sums else encoded
    names = kept.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    added = ["ids_bytes", "ids_crc", "text_bytes", "text_crc", "chars"]

    def summed(ids: bytes, text: str, k: int):
        text = unmarked(text) if k == 0 else text.replace(MARK, " ")
        plain = text.encode("utf-8", "surrogatepass")
        return len(ids), zlib.crc32(ids), len(plain), zlib.crc32(plain), len(text)

    def decode(batches):
        voc = vocabulary(path)
        voc.forget()  # a worker that has encoded holds the words of an earlier stage
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                columns = [part.column(c) for c in names]
                if sums:
                    numbers = zip(*[summed(raw, voc.decode(raw), k) for raw, k in zip(
                        (i.as_py() for i in part.column("ids")), part.column("k").to_pylist())])
                    yield pa.RecordBatch.from_arrays(
                        [*columns, *(pa.array(n, pa.int64()) for n in numbers)], names=[*names, *added])
                else:
                    texts = [voc.decode(i.as_py()) for i in part.column("ids")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())],
                                                     names=[*names, "text"])

    if sums:
        return encoded.mapInArrow(decode, ", ".join([kinds, *(f"{c} long" for c in added)]))
    return encoded.mapInArrow(decode, f"{kinds}, text string")


def digest_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per text: ``id_col``, n_chunks, n_tokens, ids_crc32 (of all ids,
    little-endian unsigned 32-bit), n_chars and text_crc32 (UTF-8) of the decoded text.

    Checksums of chunks are combined in order, so no text is put together, and ids and
    texts stay in the task that decodes them.
    """
    kind = encoded.schema[id_col].dataType.simpleString()
    sums = decode_chunks(encoded.select(F.col("_row").alias("part"), F.col(id_col).alias("_id"), "k", "ids"),
                         path, sums=True)

    def joined(crcs, sizes):
        total = crcs[0]
        for crc, size in zip(crcs[1:], sizes[1:]):
            zeros = bytes(size)
            total = crc ^ zlib.crc32(zeros, total) ^ zlib.crc32(zeros)
        return total

    def fold(batches):
        names = ["_id", "ids_bytes", "ids_crc", "text_bytes", "text_crc", "chars"]
        for key, nb, crc, tb, tcrc, chars in runs_of(batches, "part", names):
            yield key[0], len(key), sum(nb) // 4, joined(crc, nb), sum(chars), joined(tcrc, tb)

    def tables(batches):
        out, id_type = [], None

        def seen():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("_id").type
                yield batch

        def table():
            kinds = [id_type] + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                names=["_id", "n_chunks", "n_tokens", "ids_crc32", "n_chars", "text_crc32"])

        for row in fold(seen()):
            out.append(row)
            if len(out) >= 8192:
                yield table()
                out = []
        if out:
            yield table()

    return (_sorted_runs(sums)
            .mapInArrow(tables, f"_id {kind}, n_chunks long, n_tokens long, ids_crc32 long, "
                                "n_chars long, text_crc32 long")
            .withColumnRenamed("_id", id_col))
