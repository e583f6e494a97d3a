"""Secret scan: fixed patterns plus sliding-window Shannon entropy.

Candidate strings are runs of key characters. Each gets the first character
class that covers it (digits with a-f; digits with letters of one case;
letters and digits; all key characters), and a window of the class's width slides over it: the counts of the
characters inside change by one in and one out per step, and the entropy
with them. A candidate is reported where windows reach the class's threshold,
unless an allow-list rule suppresses it.

Work is per row with no shuffle. Offsets are code points, end exclusive.
Defined results: null text is empty and has no spans; repeated rows are
scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# --- Fixed values: base patterns, kinds in listed order ------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")

# runs of 32 or more are what remains of the maximal runs once short ones are dropped
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.ASCII)


@dataclass(frozen=True)
class CharClass:
    """Characters, window width and least entropy (bits) of one class."""

    name: str
    full: re.Pattern
    window: int
    least: float


CLASSES = (
    CharClass("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 32, 3.0),
    CharClass("lower", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 24, 3.6),
    CharClass("alnum", re.compile(r"[A-Za-z0-9]+"), 20, 3.7),
    CharClass("key", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 4.0),
)

#: Candidates that are no secrets: plain numbers and rules, UUIDs.
ALLOW = (
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
)

#: Candidates made like words: no digit at all (words, joined words, paths), slugs and
#: paths of words and short numbers, names with a number. They are allowed unless a window
#: holds more bits than words do.
WORDS = (
    re.compile(r"[^0-9]+"),
    re.compile(r"([A-Za-z]+|[0-9]{1,8})([+/_=-]+([A-Za-z]+|[0-9]{1,8}))*[+/_=-]*"),
    re.compile(r"[A-Za-z]+[0-9]{1,4}"),
)

#: (window, bits): what joined words stay below; shorter candidates cannot be told from words.
MOST_OF_WORDS = ((32, 4.3), (24, 4.15))


def window_entropies(s: str, width: int) -> Iterable[float]:
    """Shannon entropy of each window of ``width`` characters, by incremental
    counts: with H = log2(w) - sum(c log2 c) / w only two terms change a step."""
    width = min(width, len(s))
    if not width:
        return
    xlog = [0.0] + [c * log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += xlog[c + 1] - xlog[c]
        counts[ch] = c + 1
        if i >= width:
            old = s[i - width]
            c = counts[old]
            total += xlog[c - 1] - xlog[c]
            counts[old] = c - 1
        if i >= width - 1:
            yield log2(width) - total / width


def wordlike(s: str) -> bool:
    """Whether a candidate is made like words and holds no more bits than they do."""
    if not any(rule.fullmatch(s) for rule in WORDS):
        return False
    for width, most in MOST_OF_WORDS:
        if len(s) >= width:
            return max(window_entropies(s, width)) < most
    return True


def entropy_spans(text: str, classes=CLASSES, allow=ALLOW) -> list[tuple[int, int]]:
    """Spans of candidate strings covered by windows of high entropy."""
    spans = []
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if any(rule.fullmatch(s) for rule in allow) or wordlike(s):
            continue
        kind = next(c for c in classes if c.full.fullmatch(s))
        width = min(kind.window, len(s))
        start = end = -1
        for i, h in enumerate(window_entropies(s, width)):
            if h < kind.least:
                continue
            if start >= 0 and i > end:
                spans.append((m.start() + start, m.start() + end))
                start = -1
            start = i if start < 0 else start
            end = i + width
        if start >= 0:
            spans.append((m.start() + start, m.start() + end))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, failing matches dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str) -> tuple[list, list]:
    """Base spans, and base spans with those the entropy method adds."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b in entropy_spans(text)
            if not any(s <= a and b <= e for s, _, e in base)]
    return base, sorted(base + more)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every span (overlaps merged) replaced by ``mark``."""
    out, at = [], 0
    end = -1
    for a, _, b in spans:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(mark)
            at = end
        out.append(text[at:a])
        end = b
    if end >= 0:
        out.append(mark)
        at = end
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_assign, n_access, n_hex, n_entropy,
    base_sha256 and spans (kind:start:end, comma-joined, by start)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    names = ["n_assign", "n_access", "n_hex", "n_entropy"]

    def scan(batches):
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text"):
                base, both = all_spans(text.as_py())
                counts.append([sum(k == i for _, k, _ in both) for i in range(4)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *cols, pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                names=["id", *names, "base_sha256", "spans"])

    out = rows.mapInArrow(scan, f"id {id_type}, " + ", ".join(f"{n} long" for n in names)
                          + ", base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every found span of the text replaced; a
    text without spans is left as it is (null stays null)."""
    at = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            texts = []
            for text in batch.column(at):
                text = text.as_py()
                texts.append(text and mask(text, all_spans(text)[1], mark))
            cols = [pa.array(texts, batch.schema.field(at).type) if i == at else c
                    for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
