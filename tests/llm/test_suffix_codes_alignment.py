"""op11, op12 and op13 against direct computations."""

import hashlib
import random
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import TABLES, docs, empty, odd  # noqa: F401
from tokenizers import Tokenizer

from ratelens.llm import alignment as A
from ratelens.llm import suffix_dedup as S
from ratelens.llm import walsh_codes as W
from ratelens.llm.queries import QUERIES
from ratelens.llm.tokens import _byte_letters, public_tokenizer

# --- op11 ------------------------------------------------------------------------------


def direct_codes(rows, parts=4, size=256, rounds=4):
    """(id, code, error, label_error, digest) by the definition, in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = []
    for i, v, lab in kept:
        x = [floor(Fraction(c) * 1024) for c in v] + [0] * (width * parts - len(v))
        whole.append((i, lab, [x[p * width:(p + 1) * width] for p in range(parts)]))
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:size]
    books = [[list(r[2][p]) for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, x in whole:
                groups.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, totals = [], Counter()
    for i, lab, x in whole:
        found = [nearest(x[p], books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in found), W.LONGEST)
        totals[lab] += error
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), error))
    return [(i, c, e, min(totals[lab], W.LONGEST), digest) for i, lab, c, e in out]


def compressed(spark, vectors, kind="float", **setting):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>, label int")
    got = W.compress_vectors(df.repartition(3), settings=W.Settings(**setting)).collect()
    return sorted(map(tuple, got), key=str)


def test_transform_is_in_sequency_order():
    for n in (1, 2, 4, 16, 32):
        h = W.transform(np.eye(n, dtype=np.int64)).T
        assert [(np.diff(r) != 0).sum() for r in h] == list(range(n))
        assert (h @ h.T == n * np.eye(n)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 11), st.integers(1, 40), st.sampled_from([3, 300]),
       st.sampled_from(["int32", "int64", "object"]), st.sampled_from([0.0, 0.2, 1.0]))
def test_search_equals_all_distances(seed, width, entries, spread, kind, few):
    rnd = np.random.default_rng(seed)
    book = rnd.integers(-spread, spread, (entries, width)).astype(kind)
    parts = rnd.integers(-spread, spread, (50, width)).astype(kind)
    found, least = W.Codebook(book, W.Settings(block=2, few=few)).nearest(parts)
    every = ((parts[:, None].astype(np.int64) - book[None].astype(np.int64)) ** 2).sum(-1)
    assert (found == every.argmin(1)).all() and (least == every.min(1)).all()


def test_vector_codes(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(12)], rnd.choice([0, 0, 0, 1, None])) for i in range(160)]
    rows += [(500, None, 1), (501, [], 1), (502, [None, 1.0], 1), (503, [float("nan")] * 12, 1),
             (504, [float("inf")] * 12, 2), (505, [1.0, 2.0], 2), (None, [0.5] * 12, 2), rows[3], rows[3],
             (3, [0.25] * 12, 0)]
    for size in (256, 8):
        assert compressed(spark, rows, entries=size, rows=16) == sorted(direct_codes(rows, size=size), key=str)
    assert compressed(spark, [(1, None, 1), (2, [None], 1)]) == []


def test_wide_numbers_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) * 10.0 ** rnd.randint(0, 7) for _ in range(5)], i % 3) for i in range(60)]
    assert compressed(spark, rows, "double", entries=9) == sorted(direct_codes(rows, size=9), key=str)
    rows += [(100, [1e300, -1e300, 2.5, 0.0, 1e-3], 1), (101, [3.4e38] * 5, None)]
    assert compressed(spark, rows, "double", entries=9) == sorted(direct_codes(rows, size=9), key=str)


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in
            spark.read.parquet(f"{TABLES}/embeddings.parquet").orderBy("vec_id").limit(300).collect()]
    got = QUERIES["op11_walsh_codes"](spark, TABLES)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got.count() == 500
    assert compressed(spark, rows) == sorted(direct_codes(rows), key=str)


def test_many_labels_are_joined_with_salts(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0], i // 2 if i % 2 else None) for i in range(80)]
    monkeypatch.setattr(W, "checked_broadcast", lambda df: df)
    assert compressed(spark, rows, entries=4) == sorted(direct_codes(rows, size=4), key=str)


# --- op12 ------------------------------------------------------------------------------


def direct_removal(rows, window=50):
    smallest, texts = {}, [(S.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for p in range(len(b) - window + 1):
            w = b[p:p + window]
            smallest[w] = min(smallest.get(w, d), d)
    out = []
    for (d, b), (name, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if smallest[b[p:p + window]] < d:
                gone[p:p + window] = b"\1" * window
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((name, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def removed(spark, rows, **setting):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, S.remove_repeats(df, settings=S.Settings(**setting)).collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=1, max_size=60))
def test_multikey_order(rows):
    words = np.array(rows, np.uint64)
    order, new = S.multikey_order(words)
    assert words[order].tolist() == sorted(rows)
    assert new.sum() == len({tuple(r) for r in rows}) and new[0]


def shared_passages(seed=3, many=120):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gam", "de", " ", "\n", "the", "of", "zz", "漢字", "x" * 9]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(8, 60))) for _ in range(12)]
    rows = [(rnd.randint(0, 400), " ".join(
        rnd.choice([rnd.choice(passages), str(rnd.random()), "pad" * rnd.randint(0, 9)])
        for _ in range(rnd.randint(0, 9)))) for _ in range(many)]
    return rows + [(None, None), (None, passages[0] * 2), (7, "a" * 300), (9, "a" * 120), (9, "\0" * 200),
                   (12, "\0" * 90), (500, ""), (501, "x" * 49), (502, "x" * 50), (3, "x" * 50), (3, "x" * 50),
                   (800, "tail"), (801, passages[3] + " and more " + passages[3])]


@pytest.mark.parametrize("setting", [{}, {"part_bytes": 3000, "range_bytes": 2000},
                                     {"part_bytes": 700, "range_bytes": 300, "sample_bytes": 5000}])
def test_repeated_passages_go(spark, setting):
    rows = shared_passages()
    want = direct_removal(rows)
    assert sum(r[2] for r in want) > 10_000
    assert removed(spark, rows, **setting) == want


def test_parts_do_not_depend_on_the_order_of_rows(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "_STEP", 256)
    rows, found = shared_passages(), []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        table = pa.table({"id": [d for d, _ in rows], "text": [t or "" for _, t in rows]})
        part = S.Part(*S._documents(table), np.zeros(0, "S104"), S.Settings())
        found.append((part.texts, part.records.keys().tolist()))
    assert found[0] == found[1]


def test_one_beginning_in_every_document(spark):
    """A hot passage behind a different beginning in each document, over many borders."""
    passage = "the same forty bytes and then some more in every single document, to its very end"
    rows = [(i, f"{hashlib.md5(str(i).encode()).hexdigest()} {passage[:30 + i % 50]} {i * 7919}") for i in range(300)]
    rows += [(1000 + i, f"{i} {passage}") for i in range(100)]
    assert removed(spark, rows, part_bytes=4000, range_bytes=800) == direct_removal(rows)


def test_removal_of_documents(spark, docs, odd, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = direct_removal(rows)
    assert removed(spark, rows, part_bytes=50_000, range_bytes=30_000) == want
    got = sorted(map(tuple, QUERIES["op12_suffix_dedup"](spark, TABLES).collect()), key=str)
    assert got == want
    monkeypatch.setattr(S, "_STEP", 1 << 12)  # anchors found in many steps
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    cut = [(d, t[:20_000] if t else t) for d, t in rows]
    assert removed(spark, cut, part_bytes=20_000, range_bytes=10_000) == direct_removal(cut)
    got = S.remove_repeats(odd).collect()
    assert len(got) == len(rows) and sum(r.n_bytes for r in got) == sum(len((t or "").encode()) for _, t in rows)
    assert S.remove_repeats(empty).collect() == []


# --- op13 ------------------------------------------------------------------------------

PATHS = [public_tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(raw):
    out, at = [], 0
    for r in raw:
        out.append((at, at + len(r)))
        at += len(r)
    return out


def direct_alignment(libraries, rows):
    tok, sp = libraries
    byte = {c: b for b, c in _byte_letters().items()}
    counts, found = Counter(), []
    for d, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
            raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                     else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                a, b = [], []
            else:
                sa, sb = spans(raw_a), spans(raw_b)
                for i, (x, y) in enumerate(sa):
                    links += [(a[i], b[j]) for j, (u, v) in enumerate(sb) if u < y and x < v]
                cuts = sorted({y for _, y in sa} & {y for _, y in sb})
                for low, high in zip([0, *cuts], cuts):
                    groups.append("|".join(",".join(str(i) for i, (_, y) in zip(ids, s) if low < y <= high)
                                           for ids, s in ((a, sa), (b, sb))))
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((d, len(a), len(b), len(groups), links, digest))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return sorted(((d, na, nb, g, len(links), sum(counts[x] == best[x[1]] for x in links),
                    sum(counts[x] for x in links), h) for d, na, nb, g, links, h in found), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=60), st.integers(1, 20))
def test_merge_path(a, b, piece):
    short = sum(a) - sum(b)
    (b if short > 0 else a).extend([1] * abs(short))  # both spell as many bytes
    a, b = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    i, j, last_a, last_b = A.merge(a, b, piece)
    sa, sb = (list(zip([0, *x], x)) for x in (a.tolist(), b.tolist()))
    assert list(zip(i.tolist(), j.tolist())) == [(x, y) for x, s in enumerate(sa) for y, t in enumerate(sb)
                                                 if s[0] < t[1] and t[0] < s[1]]
    assert a[last_a].tolist() == b[last_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_alignment(spark, docs, empty, libraries):
    rows = [(r.doc_id, r.text if not r.text else r.text[:2500]) for r in docs.select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, " "), (9003, "a  b"), (9004, "x▁y"), (9006, "漢字 🙂"),
             (9005, "<|endoftext|> <s> </s> <unk> <0x41>"), (9007, "a\nb "), (9008, "x" * 3000), (None, "the end"),
             (7, "the end"), (7, "the end"), (9009, " lead"), (9010, "é ́ b\tc\r\n"), (9011, "ſ ﬁ Σ a̐")]
    want = direct_alignment(libraries, rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "doc_id long, text string, block string, _id int").repartition(3)
    for setting in (A.Settings(), A.Settings(block=4000, piece=7, looked_up=300)):
        got = A.align_documents(df, *PATHS, settings=setting)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                               "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert A.align_documents(empty, *PATHS).collect() == []


def test_alignment_query(spark, docs, libraries):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 6000]
    texts = [t for _, t in rows]
    aligner = A.Aligner(*PATHS, A.Settings())
    tok, sp = libraries
    for t in texts:  # whole texts, in order
        a, b = aligner.tokens(t)
        if t:
            assert a.tolist() == tok.encode(" " + t, add_special_tokens=False).ids and b.tolist() == sp.encode(t)
    got = QUERIES["op13_merge_path_alignment"](spark, TABLES)
    assert got.count() == docs.count() and got.where("n_links < greatest(n_a, n_b)").count() == 0


def test_tables_swap_generations(libraries):
    table = A.Generations(lambda w: w * 2, 3)
    assert [table[w] for w in "abcabdeaf"] == [w * 2 for w in "abcabdeaf"]
    assert len(table) <= 3 and len(table._old) <= 3
