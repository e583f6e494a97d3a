"""op8 and op5: spans against a direct scan, entropy by definition, held-out accuracy."""

import hashlib
import re
from collections import Counter
from math import log2

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF_SMALL, docs, empty, odd  # noqa: F401
from pyspark.sql import functions as F

from ratelens.llm import quality as Q
from ratelens.llm import secrets as S
from ratelens.llm.common import remainder

PARTS = st.sampled_from(["token=", "Secret: '", "api_key = ", "aBcDeF12", "AKIA", "ABCD1234EFGH5678",
                         "0123456789abcdef", "f" * 20, " ", "\n", "é", "pässword=", "ſecret=abcdefgh",
                         "password", '"', "=", "q9Zx7LmP2", "-", "word"])


def direct(text):
    out = []
    kinds = [("assign", r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:(?:o|O)(?:r|R))?(?:d|D)|(?:s|S)(?:e|E)(?:c|C)(?:r|R)(?:e|E)(?:t|T)|(?:t|T)(?:o|O)(?:k|K)(?:e|E)(?:n|N)|(?:a|A)(?:p|P)(?:i|I)_?(?:k|K)(?:e|E)(?:y|Y))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
              lambda m: len(m.group(2)) >= 8),
             ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
             ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32)]
    for order, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}")
                for m in re.finditer(pattern, text) if good(m)]
    return ",".join(x[2] for x in sorted(out))


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_a_direct_scan(text):
    assert S.joined(S.base_spans(text)) == direct(text)


@settings(max_examples=100, deadline=None)
@given(st.text("abcd01", max_size=60), st.integers(1, 30))
def test_incremental_entropy(text, width):
    got = list(S.window_entropies(text, width))
    w = min(width, len(text))
    want = [-sum(c / w * log2(c / w) for c in Counter(text[i:i + w]).values())
            for i in range(len(text) - w + 1)] if w else []
    assert np.allclose(got, want, atol=1e-9)


def entropy(s):
    return sum(c / len(s) * -log2(c / len(s)) for c in Counter(s).values())


def windowed(text):
    """Spans by the entropy of every window taken anew, covered positions merged."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text, re.ASCII):
        s = m.group()
        if any(r.fullmatch(s) for r in S.ALLOW):
            continue
        if any(r.fullmatch(s) for r in S.WORDS):
            limit = next(((w, h) for w, h in S.MOST_OF_WORDS if w <= len(s)), None)
            if limit is None or all(entropy(s[i:i + limit[0]]) < limit[1]
                                    for i in range(len(s) - limit[0] + 1)):
                continue
        kind = [c for c in S.CLASSES if c.full.fullmatch(s)][0]
        w = min(kind.window, len(s))
        starts = [i for i in range(len(s) - w + 1) if entropy(s[i:i + w]) >= kind.least]
        merged = []
        for i in starts:
            if merged and i <= merged[-1][1]:
                merged[-1][1] = i + w
            else:
                merged.append([i, i + w])
        out += [(m.start() + a, m.start() + b) for a, b in merged]
    return out


PIECES = st.one_of(
    st.text("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", min_size=1, max_size=70),
    st.text("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=20, max_size=50),
    st.sampled_from(["some", "Words", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "/usr/lib/", "-", " ", "2024", ". "]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=8).map("".join))
def test_entropy_spans_equal_direct_windows(text):
    assert S.entropy_spans(text) == windowed(text)


def test_keys_of_letters_are_found_and_words_are_not():
    rnd = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    keys = ["".join(rnd.choice(letters, 40)) for _ in range(500)]
    assert sum(bool(S.entropy_spans(k)) for k in keys) >= 450
    ends = ["".join(rnd.choice(letters, 28)) + f"{rnd.integers(10_000):04}" for _ in range(500)]
    assert sum(bool(S.entropy_spans(k)) for k in ends) >= 450
    for clean in ("donaudampfschifffahrtsgesellschaft", "internationalizationAndLocalizationSettings",
                  "/usr/local/share/documents/reports/annual", "get-the-list-of-all-the-items-2024"):
        assert S.entropy_spans(f"see {clean} there") == []


def test_entropy_adds_random_keys_and_leaves_words():
    key = "q9Zx7LmP2vR4tYw8KbN3sD6f"
    assert S.entropy_spans(f"the {key} end") == [(4, 4 + len(key))]
    for clean in ("internationalizationofeverything", "a" * 40, "1234567890" * 4, "some/path/to-a/file_name",
                  "123e4567-e89b-12d3-a456-426614174000", "Reentationing%%%", "chapter1234 " * 5):
        assert S.entropy_spans(clean) == []


def test_mask_replaces_found_spans_only():
    text = 'x token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" the'
    assert S.mask(text, S.all_spans(text)[1]) == 'x [SECRET]" the'
    assert S.mask("clean text", S.all_spans("clean text")[1]) == "clean text"


def test_scan_over_the_table(docs, odd, empty):
    for df in (docs, odd):
        got = Counter((r.doc_id, r.base_sha256) for r in S.scan_secrets(df).collect())
        assert got == Counter((r.doc_id, hashlib.sha256(direct(r.text or "").encode()).hexdigest())
                              for r in df.collect())
    assert S.scan_secrets(empty).collect() == []
    masked = S.mask_secrets(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()


def test_shape():
    assert [Q.shape(w) for w in ("Foo,", "BAR!!", "an%%%", "x12y", "###", "é")] == \
        ["Aa,", "A!", "a%", "a0a", "#", "a"]


def test_scores_equal_the_sparse_dot_product(docs):
    """Whole-text scores against one feature at a time."""
    s = Q.Settings(bits=12)
    weights = np.random.default_rng(1).normal(size=(1 << 12) + 1).astype(np.float32)
    got = {r.doc_id: r.score for r in Q.score_quality(docs, weights, settings=s).collect()}
    f = Q.Features(12)
    for r in docs.limit(40).collect():
        numbers, words = next(f.many([r.text or ""]))
        x = Counter(numbers.tolist())
        z = weights[-1] + sum(n / max(words, 1) ** .5 * float(weights[i]) for i, n in x.items())
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-5


def test_ftrl_update_is_the_published_one():
    s = Q.Settings(bits=3)
    model, i, x = Q.Ftrl(s), np.array([2]), np.array([1.5])
    model.learn(i, x, 1)
    g = (0.5 - 1) * 1.5
    assert np.isclose(model.z[2], g) and np.isclose(model.n[2], g * g)
    w = -(g + s.l1) / ((s.beta + abs(g)) / s.alpha + s.l2)
    assert np.isclose(model.weights_at(i)[0], w)


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    held = remainder("doc_id", 3) == 1
    w = Q.train(docs, labels, usable=~held)
    rows = (Q.score_quality(docs, w).where(held).join(labels, "doc_id")
            .select("score", "quality", "predicted").collect())
    good = [r.score for r in rows if r.quality]
    bad = [r.score for r in rows if not r.quality]
    auc = np.mean([[g > b for g in good] for b in bad])
    assert auc > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert sum(r.predicted for r in rows if r.quality) >= 0.98 * len(good)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (5, 0)],
                                   "doc_id long, quality int")
    w = Q.train(odd, labels)
    rows = Q.score_quality(odd, w).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (None, 0, 1, 2)} - {0}) >= 1
    none = Q.train(odd, labels.limit(0))
    assert {r.score for r in Q.score_quality(odd, none).collect()} == {0.5}
    assert Q.filter_quality(odd, none).columns == odd.columns
    assert Q.score_quality(empty, w).collect() == [] and len(Q.train(empty, labels)) == len(w)


def test_labels_never_enter_a_score(spark, docs):
    w = Q.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    a = {r.doc_id: r.score for r in Q.score_quality(docs, w).collect()}
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    assert a == {r.doc_id: r.score for r in Q.score_quality(moved, w).collect()}
