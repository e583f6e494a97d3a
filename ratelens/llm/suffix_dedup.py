"""Removal of passages that repeat across documents, by a distributed suffix array.

A byte goes when a string of ``window`` bytes that covers it also starts in a document
with a smaller id. Suffixes are sorted where texts can meet only: in
every window the 12 bytes of least hash are its anchor (the leftmost, of equal ones). Equal
windows have their anchors at equal places, so windows are compared among suffixes
that start at anchors; about one position in 19 is one. A suffix carries the bytes before it that its
windows reach, and stands for the run of windows that share the anchor.

1. Documents are dealt into parts by a hash of the row. A part sorts its suffixes by multikey
   quicksort (eight bytes a key, each pass only over what still ties), merges equal ones with
   the smallest and largest id that hold them, and cuts the order at splitters
   taken from a sample of the suffixes.
2. A range sorts what all parts sent, again by multikey quicksort. Common prefixes of
   neighbours tell which windows can occur in another suffix; only these
   are cut out and sorted themselves. The smallest id of every window goes back
   to the parts that hold it in a larger document.
3. Windows whose part behind the anchor is a prefix of a splitter may have equals across that border.
   They are compared across borders: each part sends its different ones, once each, to
   ranges of their own.
4. Parts find their suffixes again, mark what the answers cover, and cut it out.

A text crosses the network once (both steps read one exchange). A key is as often in a range as there are parts,
whatever the number of documents that hold it; a splitter may fall inside any group of equal beginnings.
Everything is a function of the rows, so a lost task gives the same again.

Defined results: null text is empty; texts below ``window`` bytes stay; null ids are smaller than
all others; rows of equal id do not remove from each other (repeated rows
stay alike); extra columns are ignored; an empty table gives no rows. A task holds a
part and some 30 times its bytes; a text longer than a part is one alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

GRAM = 12
NO_ID = -(1 << 63)  # a null id
CROSS = 1 << 31  # numbers of windows compared across borders begin here
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_STEP = 1 << 18  # positions whose anchors are found at a time


@dataclass(frozen=True)
class Settings:
    window: int = 50
    part_bytes: int = 6 << 20
    range_bytes: int = 8 << 20  # of text whose suffixes fill a range
    sample_bytes: int = 32 << 20  # of text read for splitters
    keys: int = 200_000  # sampled suffixes that reach the driver, at most

    @property
    def behind(self) -> int:
        """Room for a window's bytes from its anchor, in whole keys."""
        return -(-self.window // 8) * 8

    @property
    def before(self) -> int:
        return -(-max(1, self.window - GRAM) // 8) * 8


def anchors(text: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Anchor of each window that starts at the ``valid`` positions of ``text`` (bytes)."""
    width = window - GRAM + 1
    out = np.empty(len(valid), np.int64)
    for a in range(0, len(text) - window + 1, _STEP):
        lo, hi = np.searchsorted(valid, [a, a + _STEP])
        if lo == hi:
            continue
        b = text[a:a + _STEP + window - 1].astype(np.uint64)
        for shift in (1, 2, 4):  # eight bytes from each position
            b = b[:-shift] | b[shift:] << np.uint64(8 * shift)
        h = b[:8 - GRAM] * _MIX[0] ^ (b[GRAM - 8:] ^ b[GRAM - 8:] >> np.uint64(29)) * _MIX[1]
        h = (h ^ h >> np.uint64(32)) * _MIX[2]
        low = np.uint64(20)
        h = h >> low << low | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach < width:  # least value of ``width`` in a row
            step = min(reach, width - reach)
            h = np.minimum(h[:-step], h[step:])
            reach += step
        at = h[valid[lo:hi] - a] & np.uint64((1 << 20) - 1)
        out[lo:hi] = at.astype(np.int64) + a
    return out


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of keys, and which rows in that order differ from the one before."""
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    at = np.arange(n)
    for j in range(1, words.shape[1]):
        group = np.cumsum(new[at])  # rows tied up to the last key
        tied = np.bincount(group, minlength=1)[group] > 1
        at, group = at[tied], group[tied]
        if not len(at):
            break
        rows = order[at]
        key = words[rows, j]
        o = np.lexsort((key, group))
        order[at], key = rows[o], key[o]
        new[at[1:]] |= key[1:] != key[:-1]
    return order, new


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian keys of eight."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of two arrays of rows of bytes."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class Records:
    """Suffixes at anchors: ``behind`` [n, bytes from the anchor, zeros behind], ``before`` [n,
    bytes up to the anchor, zeros in front]; windows start ``low`` to ``high`` bytes before the anchor."""

    def __init__(self, behind, before, low, high, window: int):
        self.behind, self.before, self.low, self.high, self.window = behind, before, low, high, window

    def __getitem__(self, at) -> Records:
        return Records(self.behind[at], self.before[at], self.low[at], self.high[at], self.window)

    def keys(self) -> np.ndarray:
        """Ordered by the bytes from the anchor, then (equal ones: shorter first) by those before."""
        lengths = (self.window - self.low.astype(np.uint64)) << np.uint64(32) | self.high.astype(np.uint64)
        return np.hstack([_words(self.behind), lengths[:, None], _words(self.before)])

    def windows(self, row: np.ndarray, back: np.ndarray) -> Records:
        """Single windows: those of these rows that start ``back`` bytes before the anchor."""
        wide, deep = self.behind.shape[1], self.before.shape[1]
        behind, before = self.behind[row], self.before[row]
        behind[np.arange(wide) >= (self.window - back)[:, None]] = 0
        before[np.arange(deep) < (deep - back)[:, None]] = 0
        return Records(behind, before, back.astype(np.uint8), back.astype(np.uint8), self.window)


class Part:
    """The documents of one part, their suffixes at anchors and the different ones among them."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], splitters: np.ndarray, settings: Settings):
        w, self.settings = settings.window, settings
        self.ids, self.texts = ids, texts
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        starts = np.ones(len(self.bytes) + 1, bool)  # positions where a window starts
        for back in range(min(w, len(self.bytes) + 1)):
            starts[np.maximum(self.ends - back, self.ends - sizes)] = False
        # a text's first byte is its own window's unless the text is shorter
        starts[(self.ends - sizes)[sizes >= w]] = True
        starts[len(self.bytes):] = False
        valid = np.flatnonzero(starts)
        anchor = anchors(self.bytes, valid, w)
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1) | (valid[1:] % _STEP == 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(valid))[:len(first)] - 1
        self.anchor = anchor[first]
        low, high = self.anchor - valid[last], self.anchor - valid[first]
        self.doc = np.searchsorted(self.ends, valid[first], "right")
        padded = np.concatenate([np.zeros(settings.before, np.uint8), self.bytes,
                                 np.zeros(settings.behind, np.uint8)])
        behind = sliding_window_view(padded, settings.behind)[self.anchor + settings.before]
        before = sliding_window_view(padded, settings.before)[self.anchor]
        behind *= np.arange(settings.behind) < (w - low)[:, None]
        before *= np.arange(settings.before) >= (settings.before - high)[:, None]
        records = Records(behind, before, low.astype(np.uint8), high.astype(np.uint8), w)
        keys = records.keys()
        self.order, new = multikey_order(keys)
        self.first = np.flatnonzero(new)  # of each different suffix, in order
        self.records = records[self.order[self.first]]
        held = ids[self.doc[self.order]]
        self.least, self.most = (f.reduceat(held, self.first) if len(held) else held
                                 for f in (np.minimum, np.maximum))
        self._cut(keys[self.order[self.first]], splitters)

    def _cut(self, keys: np.ndarray, splitters: np.ndarray) -> None:
        """Range of each different suffix, and its windows that may have equals beyond a border."""
        w, many = self.settings.window, len(splitters)
        text = keys.astype(">u8").view(f"S{8 * keys.shape[1]}").ravel()
        bounds = np.searchsorted(text, splitters)
        self.range = np.repeat(np.arange(many + 1), np.diff(np.concatenate([[0], bounds, [len(text)]])))
        reach = np.zeros(len(text), np.int64)
        size = self.settings.behind
        heads = np.frombuffer(splitters.tobytes(), np.uint8).reshape(many, splitters.dtype.itemsize)[:, :size] \
            if many else np.zeros((0, size), np.uint8)
        for side in (0, 1):
            at = np.flatnonzero((self.range >= 1) if side == 0 else (self.range < many))
            for a in range(0, len(at), 1 << 16):
                some = at[a:a + (1 << 16)]
                here = common_prefix(self.records.behind[some], heads[self.range[some] - 1 + side])
                reach[some] = np.maximum(reach[some], here)
        # windows from w - reach bytes before the anchor on
        low, high = self.records.low.astype(np.int64), self.records.high.astype(np.int64)
        from_ = np.maximum(low, w - reach)
        count = np.maximum(0, high - from_ + 1)
        self.high = high - count  # windows of the range itself: low to this
        row = np.repeat(np.arange(len(low)), count)
        back = from_[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        windows = self.records.windows(row, back)
        order, new = multikey_order(windows.keys())
        self.cross_row, self.cross_back = row[order], back[order]
        self.cross_first = np.flatnonzero(new)
        self.cross = windows[order[self.cross_first]]

    def payloads(self, part: int):
        """(range, part, packed records) for every range this part has suffixes in."""
        many = int(self.range[-1]) + 1 if len(self.range) else 0
        inside = np.flatnonzero(self.high >= self.records.low)
        bounds = np.searchsorted(self.range[inside], np.arange(many + 1))
        for r, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                at = inside[a:b]
                own = self.records[at]
                own.high = self.high[at].astype(np.uint8)
                yield r, part, packed(own, at, self.least[at], self.most[at])

    def cross_payloads(self, part: int, ranges: int):
        """The same for windows compared across borders, dealt by their bytes."""
        if not len(self.cross_first):
            return
        least, most = (f.reduceat(v[self.cross_row], self.cross_first) for f, v in
                       ((np.minimum, self.least), (np.maximum, self.most)))
        keys = self.cross.keys()
        h = np.zeros(len(keys), np.uint64)
        for j in range(keys.shape[1]):
            h = (h ^ keys[:, j]) * _MIX[j % 3]
            h ^= h >> np.uint64(31)
        to = (h % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        for at in np.split(order, cuts[1:]):
            yield ranges + int(to[at[0]]), part, packed(self.cross[at], at + CROSS, least[at], most[at])

    def removed(self, answers: np.ndarray) -> np.ndarray:
        """Which bytes go. ``answers``: rows (number, low, high, id): a smaller id that holds these windows."""
        number, low, high, least = answers["number"].astype(np.int64), answers["low"].astype(np.int64), \
            answers["high"].astype(np.int64), answers["id"]
        across = number >= CROSS
        group = number[across] - CROSS
        upto = np.append(self.cross_first, len(self.cross_row))
        count = upto[group + 1] - upto[group]
        at = upto[group].repeat(count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        number = np.concatenate([number[~across], self.cross_row[at]])
        low = np.concatenate([low[~across], self.cross_back[at]])
        high = np.concatenate([high[~across], self.cross_back[at]])
        least = np.concatenate([least[~across], least[across].repeat(count)])
        upto = np.append(self.first, len(self.order))
        cover = np.zeros(len(self.bytes) + 1, np.int64)
        for a in range(0, len(number), 1 << 18):
            some = slice(a, a + (1 << 18))
            count = upto[number[some] + 1] - upto[number[some]]
            at = upto[number[some]].repeat(count) + np.arange(count.sum()) \
                - np.repeat(np.cumsum(count) - count, count)
            seg = self.order[at]
            hit = least[some].repeat(count) < self.ids[self.doc[seg]]
            seg = seg[hit]
            cover += np.bincount(self.anchor[seg] - high[some].repeat(count)[hit], minlength=len(cover))
            cover -= np.bincount(self.anchor[seg] - low[some].repeat(count)[hit] + self.settings.window,
                                 minlength=len(cover))
        return np.cumsum(cover[:-1]) > 0

    def results(self, answers: np.ndarray):
        """Per document: bytes, removed bytes, removed runs and digest of the rest."""
        gone = self.removed(answers)
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        new = gone.copy()
        new[1:] &= ~gone[:-1]
        at = starts[starts < len(gone)]
        new[at] = gone[at]
        upto, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, new))
        for t, a, b in zip(self.texts, starts.tolist(), self.ends.tolist()):
            lost = int(upto[b] - upto[a])
            rest = self.bytes[a:b][~gone[a:b]].tobytes() if lost else t
            yield len(t), lost, int(runs[b] - runs[a]), hashlib.sha256(rest).hexdigest()


_ANSWER = np.dtype([("number", "<u4"), ("low", "u1"), ("high", "u1"), ("id", "<i8")])


def _held(records: Records, low, high) -> np.ndarray:
    """Which bytes of [before, behind] belong to the windows."""
    deep = records.before.shape[1]
    at = np.arange(deep + records.behind.shape[1])
    return (at >= (deep - high.astype(np.int64))[:, None]) & (at < (deep + records.window - low.astype(np.int64))[:, None])


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of 64-bit numbers, low ones first: equal bytes side by side are small when compressed."""
    return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(len(values), 8).T


def packed(records: Records, number, least, most) -> bytes:
    """Records without the zeros around them; numbers (ascending) by their differences."""
    n = len(number)
    text = np.hstack([records.before, records.behind])[_held(records, records.low, records.high)]
    raw = [np.array([n, len(text)], "<i8"), records.low, records.high, _planes(np.diff(number, prepend=0)),
           _planes(least), _planes(most - least), text]  # differences may wrap around; so do sums
    return zstandard.ZstdCompressor(level=6).compress(b"".join(x.tobytes() for x in raw))


def unpacked(blobs: list[bytes], settings: Settings):
    """Records of all blobs, with number, least, most and blob of each."""
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for k, blob in enumerate(blobs):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, size = np.frombuffer(raw, "<i8", 2).tolist()
        low, high = np.frombuffer(raw, np.uint8, 2 * n, 16).reshape(2, n)
        numbers = np.frombuffer(raw, np.uint8, 24 * n, 16 + 2 * n).reshape(3, 8, n)
        number, least, most = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in numbers)
        text = np.frombuffer(raw, np.uint8, size, 16 + 26 * n)
        for c, x in zip(columns, (low, high, np.cumsum(number), least, least + most, np.full(n, k), text)):
            c.append(x)
    low, high, number, least, most, blob, text = map(np.concatenate, columns)
    rows = np.zeros((len(low), settings.before + settings.behind), np.uint8)
    records = Records(rows[:, settings.before:], rows[:, :settings.before], low, high, settings.window)
    rows[_held(records, low, high)] = text
    return records, number, least, most, blob


def smallest_ids(records: Records, least: np.ndarray):
    """(order, first, entries): the order of the records, the first of each different one, and
    (which, low, high, id): the smallest id that holds these windows of it."""
    order, new = multikey_order(records.keys())
    first = np.flatnonzero(new)
    own = records[order[first]]
    held = np.minimum.reduceat(least[order], first)
    w = records.window
    near = common_prefix(own.behind[1:], own.behind[:-1])
    near = np.minimum(near, w - np.maximum(own.low[1:], own.low[:-1]).astype(np.int64))
    reach = np.zeros(len(first), np.int64)
    reach[1:] = near
    reach[:-1] = np.maximum(reach[:-1], near)
    low, high = own.low.astype(np.int64), own.high.astype(np.int64)
    # windows from here on share the bytes behind the anchor with another suffix
    from_ = np.minimum(np.maximum(low, w - reach), high + 1)
    count = high - from_ + 1
    row = np.repeat(np.arange(len(first)), count)
    back = from_[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    smallest = held[row].copy()
    if len(row):
        # those that share a place and all their bytes are the same window
        strip = np.hstack([own.before, own.behind])
        flat = sliding_window_view(strip.ravel(), w)[row * strip.shape[1] + own.before.shape[1] - back]
        keys = np.zeros((len(row), -(-(w + 1) // 8) * 8), np.uint8)
        keys[:, :w] = flat
        keys[:, w] = back
        at, differ = multikey_order(_words(keys))
        start = np.flatnonzero(differ)
        size = np.diff(np.append(start, len(at)))
        smallest[at] = np.minimum.reduceat(held[row[at]], start).repeat(size)
    lone = np.flatnonzero(from_ > low)
    # neighbouring windows of one suffix with one answer are one entry
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (smallest[1:] != smallest[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(row))[:len(start)] - 1
    entries = [np.concatenate(x) for x in (
        (lone, row[start]), (low[lone], back[start]), (from_[lone] - 1, back[last]),
        (held[lone], smallest[start]))]
    return order, first, entries


def answers(blobs: list[bytes], settings: Settings):
    """(blob, answers) of one range for the blobs whose part has something to remove."""
    records, number, least, most, blob = unpacked(blobs, settings)
    order, first, (which, low, high, held) = smallest_ids(records, least)
    upto = np.append(first, len(order))
    count = upto[which + 1] - upto[which]
    at = order[upto[which].repeat(count) + np.arange(count.sum())
               - np.repeat(np.cumsum(count) - count, count)]
    hit = held.repeat(count) < most[at]
    at = at[hit]
    out = np.empty(len(at), _ANSWER)
    out["number"] = number[at]
    out["low"], out["high"], out["id"] = (x.repeat(count)[hit] for x in (low, high, held))
    by = np.argsort(blob[at], kind="stable")
    out, to = out[by], blob[at][by]
    for k in np.unique(to):
        yield int(k), out[to == k].tobytes()


# --- distributed steps ---------------------------------------------------------------

def _documents(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts in an order that does not depend on how rows came over the network:
    both steps have to number the suffixes of a part alike."""
    ids = [NO_ID if i is None else i for i in table.column("id").to_pylist()]
    texts = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return np.array([ids[k] for k in order], np.int64), [texts[k] for k in order]


def sample_splitters(rows: DataFrame, total: int, ranges: int, settings: Settings) -> np.ndarray:
    """At most ``ranges`` - 1 different keys that cut a sample of the suffixes evenly."""
    width = settings.behind + 8 + settings.before
    if ranges == 1:
        return np.zeros(0, f"S{width}")
    share = min(1.0, settings.sample_bytes / total)
    # suffixes are one in some 18 positions
    step = max(1, int(total * share / 18 / min(settings.keys, 256 * ranges)))

    def keys(batches):
        for batch in batches:
            ids, texts = _documents(pa.Table.from_batches([batch]))
            for a in range(0, len(texts), 256):
                part = Part(ids[a:a + 256], texts[a:a + 256], np.zeros(0, f"S{width}"), settings)
                found = part.records[np.arange((a // 256) % step, len(part.first), step)].keys().astype(">u8")
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in found], pa.binary())], names=["key"])

    chosen = rows.where(F.pmod("place", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "text")
    sample = chosen.mapInArrow(keys, "key binary").limit(4 * settings.keys).toArrow().column("key")
    found = np.sort(np.array(sample.to_pylist(), f"S{width}"))
    if not len(found):
        return found
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   settings: Settings = Settings()) -> DataFrame:
    """One row per document: ``id_col`` (long), n_bytes, n_removed, n_spans, kept_sha256."""
    text = text_or_empty(text_col)
    key = F.col(id_col).cast("long")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, ranges = (max(1, -(-total // size)) for size in (settings.part_bytes, settings.range_bytes))
    place = F.pmod(F.xxhash64(key, text), F.lit(1 << 62))
    rows = docs.select(key.alias("id"), text.alias("text"), place.alias("place"))
    splitters = sample_splitters(rows, total, ranges, settings)
    # the same dealing in both steps, so that Spark moves the texts once
    dealt = rows.select("id", "text", F.pmod(F.shiftright("place", 20), F.lit(parts)).alias("part"))

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = Part(*_documents(table), splitters, settings)
        number = key[0].as_py()
        found = [*part.payloads(number), *part.cross_payloads(number, ranges)]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                        names=["range", "part", "records"])

    def compare(table: pa.Table) -> pa.Table:
        to = table.column("part").to_pylist()
        found = list(answers(table.column("records").to_pylist(), settings))
        return pa.table([pa.array([to[k] for k, _ in found], pa.int64()),
                         pa.array([a for _, a in found], pa.binary())], names=["part", "answers"])

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        part = Part(*_documents(texts), splitters, settings)
        ids = [None if i == NO_ID else i for i in part.ids.tolist()]
        given = b"".join(found.column("answers").to_pylist()) if found.num_rows else b""
        numbers = list(zip(*part.results(np.frombuffer(given, _ANSWER)))) or [(), (), (), ()]
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in numbers[:3]),
                         pa.array(numbers[3], pa.string())],
                        names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = (dealt.groupBy("part").applyInArrow(send, "range long, part long, records binary")
             .groupBy("range").applyInArrow(compare, "part long, answers binary"))
    return (dealt.groupBy("part").cogroup(found.groupBy("part"))
            .applyInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
            .withColumnRenamed("id", id_col))
