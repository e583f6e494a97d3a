"""Whole-text encoding with the ``tokenizers`` library, memoised per word.

Both public BPE files split a text before every space that follows a
non-space, so the ids of a text are the ids of its space-delimited words in
turn. Words repeat a lot; each worker keeps a bounded table of word ids and
merges only new ones, with ``tiktoken`` where the file's merges can be told as
ranks (``ranked``), which is faster. Texts of characters whose classes all libraries
agree on are split and merged by it whole. Texts where a space follows
other white space, and words that are not letters followed by marks,
go through the library's full encoding. Results are always those of
``Tokenizer.encode(text, add_special_tokens=False).ids``; strings that look
like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import resident

MAX_WORDS = 600_000  # entries of a worker's word table (memory bound, not a limit on words)
KEPT_LENGTH = 256  # longer words are not kept
TOGETHER = 1 << 20  # characters of texts whose words are looked up and learned in one call
END = b"\0"  # behind the bytes that end a word
LONG_PIECE = 2000  # from here on the library merges, whose time does not grow with the square
#: Letters, marks and white space that every Unicode version puts into the same classes.
_AGREED = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u017f]*")
_LONG = re.compile(rf"\S{{{LONG_PIECE}}}|\s{{{LONG_PIECE}}}")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which can join words


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    are moved, in order, to code points from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(moved)}


def _packed(ids) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Generations(dict):
    """Values computed on a miss and kept in two generations: a full young one
    becomes the old one, whose entries come back when they are met again. So the table
    is bounded, and words that occur once do not keep later frequent ones out."""

    def __init__(self, compute, size: int = MAX_WORDS // 2):
        super().__init__()
        self._compute, self._size, self._old = compute, size, {}
        self.turns = 0  # how often the young one became the old one

    def __missing__(self, word):
        if len(word) > KEPT_LENGTH:
            return self._compute(word)
        value = self._old.get(word)
        if value is None:
            value = self._compute(word)
        if len(self) < self._size:
            self[word] = value
            return value
        return self.add(word, value)

    def add(self, word, value):
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
            self.turns += 1
        self[word] = value
        return value

    def add_all(self, words, values) -> None:
        if len(self) + len(words) <= self._size:
            self.update(zip(words, values))
        else:
            for word, value in zip(words, values):
                self.add(word, value)

    def values_of(self, words: list, compute) -> list:
        """The values of distinct words; ``compute`` gives those of many new words at once, and may leave some out."""
        values = [*map(self.get, words)]
        new = []
        for i in [i for i, v in enumerate(values) if v is None]:
            value = self._old.get(words[i])
            if value is None:
                new.append(i)
            else:
                values[i] = self.add(words[i], value)
        known = compute([words[i] for i in new if len(words[i]) <= KEPT_LENGTH])
        self.add_all(known.keys(), known.values())
        for i in new:
            value = known.get(words[i])
            values[i] = self[words[i]] if value is None else value
        return values

    def unknown(self, words) -> list:
        """Of these words those in neither generation."""
        return [w for w in words if w not in self and w not in self._old]


#: How a byte-level file that names no pattern of its own splits a text.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                      r"|\s+(?!\S)|\s+")


def ranked(tokenizer: str):
    """A ``tiktoken`` encoding with the merges of a tokenizer file (its JSON text), and the id
    of each rank; None where the merges cannot be told as ranks.

    A rank belongs to the bytes a merge makes. Files with a mark for word ends have
    a second alphabet, bytes that end a word; they are written with the byte ``END``
    behind, and these joins come before all merges. Their encoding splits a text behind
    each ``END``, so a row of words without that character is encoded in one call.
    """
    import tiktoken
    model = json.loads(tokenizer)["model"]
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") \
            or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    byte = {c: bytes([b]) for b, c in _byte_letters().items()}
    mark = model.get("end_of_word_suffix") or ""

    def raw(token: str) -> bytes:
        end = bool(mark) and token.endswith(mark)
        return b"".join(byte[c] for c in (token[:-len(mark)] if end else token)) + END * end

    vocabulary = model["vocab"]
    ranks = {bytes([b]): b for b in range(256)}
    names = {bytes([b]): c for b, c in _byte_letters().items()}
    if mark:
        for b, c in _byte_letters().items():
            ranks[bytes([b]) + END] = 256 + b
            names[bytes([b]) + END] = c + mark
    first = len(ranks)
    for k, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        key = raw(left + right)
        if key in ranks:
            return None  # two merges make the same bytes
        ranks[key], names[key] = first + k, left + right
    if any(name not in vocabulary for name in names.values()):
        return None
    ids = np.zeros(len(ranks), "<u4")
    for key, rank in ranks.items():
        ids[rank] = vocabulary[names[key]]
    pattern = r"[^\x00]+\x00" if mark else BYTE_LEVEL_PATTERN
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={}), ids


class Encoder:
    """``encode(text) -> bytes``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.folds = self.tok.normalizer is not None  # lower-cases and drops white space
        self.ranks = ranked(self.tok.to_str())
        # the packed id of each rank: a word has a few, for which an array costs more than it saves
        self.packed = self.ranks and [x.tobytes() for x in self.ranks[1]].__getitem__
        self.end = END if self.folds else b""
        if self.folds and self.ranks:  # of each rank whether it ends a word
            self.ends = np.zeros(len(self.ranks[1]), bool)
            self.ends[[r for raw, r in self.ranks[0]._mergeable_ranks.items() if raw[-1:] == END and r]] = True
        # a space whose predecessor is white space too, or white space at the end
        self.unsafe = re.compile(r"\s |\s\Z")
        self.pieces = Generations(self._piece)
        self.words = Generations(self._folded_word if self.folds else self._spaced_word)

    def _library(self, text: str) -> bytes:
        return _packed(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        if self.ranks is None or len(raw) > LONG_PIECE:
            spelled = raw.decode("latin-1").translate(self.letters)
            return _packed([t.id for t in self.model.tokenize(spelled)])
        return b"".join(map(self.packed, self.ranks[0]._core_bpe.encode_single_piece(raw + self.end)))

    def _agreed(self, text: str) -> bool:
        """Whether ``tiktoken`` splits the whole text as the library does, and in linear time."""
        return (self.ranks is not None and not self.folds and _AGREED.fullmatch(text) is not None
                and _LONG.search(text) is None)

    def _whole(self, text: str) -> bytes:
        encoding, ids = self.ranks
        return ids[encoding._core_bpe.encode_ordinary(text)].tobytes()

    def _plain(self, text: str) -> bytes:
        return self._whole(text) if self._agreed(text) else self._library(text)

    def _split(self, word: str) -> tuple[str, str]:
        body = word.rstrip(_MARKS)
        return (body, word[len(body):]) if body.isalpha() and "<|" not in word else ("", "")

    def _spaced_word(self, word: str) -> bytes:
        body, mark = self._split(word)
        if not body:
            return self._plain(" " + word)
        ids = self.pieces[" " + body]
        return ids + self.pieces[mark] if mark else ids

    @staticmethod
    def lowers(text: str) -> bool:
        """Whether the normalizer does no more to the letters of ``text`` than ``str.lower``: ASCII and the Latin
        letters made with marks, which are composed already."""
        return text.isascii() or _AGREED.fullmatch(text) is not None

    def _folded_word(self, word: str) -> bytes:
        if not word:
            return b""
        body = word.rstrip(_MARKS)  # as _split, which costs a call for each word not seen before
        mark = word[len(body):]
        if not body.isalpha() or "<|" in mark:
            return self._library(word)
        body = body.lower() if self.lowers(body) else self.tok.normalizer.normalize_str(body)
        if not body.isalpha():
            return self._library(word)
        return self.pieces[body] + self.pieces[mark] if mark else self.pieces[body]

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids of those of the words that are letters followed by marks, in one call."""
        new, pieces, counts = [], [], []
        all_lower = self.lowers("".join(words))
        for word in words:
            body = word.rstrip(_MARKS)
            if not body.isalpha() or not (all_lower or self.lowers(body)):
                continue
            low, mark = body.lower(), word[len(body):]
            if "<|" in mark or not low.isalpha():
                continue
            new.append(word)
            pieces.append(low)
            if mark:
                pieces.append(mark)
            counts.append(2 if mark else 1)
        if not new:
            return {}
        end = END.decode()
        ranks = np.array(self.ranks[0]._core_bpe.encode_ordinary(end.join(pieces) + end))
        stops = (np.flatnonzero(self.ends[ranks]) + 1)[np.cumsum(counts) - 1]
        raw, stops = self.ranks[1][ranks].tobytes(), (4 * stops).tolist()
        return dict(zip(new, [raw[a:b] for a, b in zip([0, *stops], stops)]))

    def _folded_text(self, text: str) -> str:
        if self.lowers(text):  # one entry for a word, however it is written
            text = text.lower()
        return text.replace("\n", " ")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; words are looked up once for all texts, and those that
        no table holds are merged together."""
        if not self.folds or self.ranks is None:
            return [*map(self.encode, texts)]
        rows = pc.split_pattern(pa.array(map(self._folded_text, texts), pa.string()), " ")
        coded = rows.flatten().dictionary_encode()
        values = self.words.values_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(),
                                      self._merged)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        at = coded.indices.to_numpy()
        counts = sizes[at]  # ids of each word of the texts
        stops = np.concatenate([[0], counts.cumsum()])
        places = np.repeat((sizes.cumsum() - sizes)[at] - stops[:-1], counts)
        places += np.arange(len(places))
        raw, bounds = ids[places].tobytes(), (4 * stops[rows.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str) -> bytes:
        if self.folds:
            return b"".join(map(self.words.__getitem__, self._folded_text(text).split(" ")))
        if not text:
            return b""
        if self._agreed(text):
            return self._whole(text)
        if self.unsafe.search(text):
            return self._library(text)
        first, *rest = text.split(" ")
        return self._library(first) + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file, so its word table outlives a task."""
    return resident(("encoder", path), lambda: Encoder(path))


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the name is the caller's parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)
