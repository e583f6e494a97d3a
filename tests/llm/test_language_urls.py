"""op1 and op2: brute-force recursion, exact counts, brute-force character models."""

import re
import zlib
from collections import Counter, defaultdict
from math import isclose, log, log10

import numpy as np
import pytest
from llm_fixtures import docs, empty, odd  # noqa: F401

from ratelens.llm import hmm as H
from ratelens.llm import urls as U
from ratelens.llm.common import remainder

SMALL = H.Settings(states=3, frequent=40, buckets=16, lookup=100, start_rows=50, start_passes=2,
                   passes=2, block=300)
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def spec_tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*SPLIT.findall(lowered.encode()), H.END]


def random_model(k, symbols, seed=1):
    rng = np.random.default_rng(seed)
    def rows(*shape):
        x = rng.random(shape) + 0.01
        return x / x.sum(axis=-1, keepdims=True)
    return H.Model(rows(k), rows(k, k), rows(k, symbols).T)


def all_paths(model, seq):
    """Likelihood as the sum over every path of states."""
    total = model.start * model.emit[seq[0]]
    for s in seq[1:]:
        total = np.array([sum(total[i] * model.move[i, j] for i in range(len(total)))
                          * model.emit[s, j] for j in range(len(total))])
    return log(total.sum())


def test_scaled_recursion_is_exact():
    model = random_model(3, 7)
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 7, n) for n in (1, 5, 2, 9, 9, 30)]
    batch = H.Batch(seqs)
    for row, got in zip(batch.order, model.forward(batch)):
        assert isclose(got, all_paths(model, seqs[row]), rel_tol=1e-9)


def test_expected_counts_equal_a_plain_forward_backward():
    model = random_model(2, 5)
    seqs = [np.array([0, 1, 4, 1]), np.array([2]), np.array([3, 3, 0])]
    _, start, moves, seen, emits = model.expected(H.Batch(seqs))
    k, want_start, want_moves, want_emits = 2, np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for s in seqs:
        a = [model.start * model.emit[s[0]]]
        for x in s[1:]:
            a.append((a[-1] @ model.move) * model.emit[x])
        b = [np.ones(k)]
        for x in s[:0:-1]:
            b.insert(0, model.move @ (model.emit[x] * b[0]))
        z = a[-1].sum()
        want_start += a[0] * b[0] / z
        for t, x in enumerate(s):
            want_emits[x] += a[t] * b[t] / z
            if t:
                want_moves += np.outer(a[t - 1], model.emit[x] * b[t]) * model.move / z
    full = np.zeros((5, 2))
    full[seen] = emits
    assert np.allclose(start, want_start) and np.allclose(moves, want_moves)
    assert np.allclose(full, want_emits)


def test_passes_do_not_lower_the_likelihood():
    rng = np.random.default_rng(3)
    seqs = [rng.choice([[0, 1, 0, 1, 2], [3, 4, 3, 4, 2]][i % 2], 30) for i in range(40)]
    counts = np.bincount(np.concatenate(seqs), minlength=5).astype(float)
    set_ = H.Settings(states=2, frequent=2, buckets=2, smooth=0.0)
    model, last = H.Model.first(counts, set_), -np.inf
    for _ in range(8):
        lik, start, moves, seen, em = model.expected(H.Batch(seqs))
        assert lik >= last - 1e-6 * abs(lik) - 3  # the added counts of starts and moves aside
        last = lik
        emits = np.zeros((5, 2))
        emits[seen] = em
        model = H.Model.fitted(start, moves, emits, counts, 0.0)


def test_every_pass_reads_all_rows_whole(spark):
    rng = np.random.default_rng(3)
    set_ = H.Settings(states=2, frequent=4, buckets=3, start_rows=1, start_passes=2, passes=1)
    seqs = [np.concatenate([rng.integers(0, 4, 4500), rng.integers(4, set_.symbols, n)])
            for n in (10, 5000, 700)] + [rng.integers(0, set_.symbols, 30)]
    counts = np.bincount(np.concatenate(seqs), minlength=set_.symbols).astype(float)
    df = spark.createDataFrame([(i, bytearray(x.astype("<u2").tobytes())) for i, x in enumerate(seqs)],
                               "_row long, syms binary")
    got, want = H.train(df, counts, set_), H.Model.first(counts, set_)
    for _ in range(3):
        _, start, moves, seen, em = want.expected(H.Batch(seqs))
        emits = np.zeros((set_.symbols, 2))
        emits[seen] = em
        want = H.Model.fitted(start, moves, emits, counts, set_.smooth)
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move)
    assert np.allclose(got.emit, want.emit)


def test_rows_scaled_every_few_steps_do_not_underflow():
    """Long sequences of rare symbols: as a recursion scaled at each step, which takes several times as long."""
    k, symbols = 3, 6
    model = random_model(k, symbols)
    model.emit[:4] *= 1e-9
    assert 1 < model.stride() <= 16
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, symbols, n) for n in (3000, 1, 17, 400, 400)]
    lik, start, moves, seen, emits = model.expected(H.Batch(seqs))
    want_lik, want_moves, want_emits = 0.0, np.zeros((k, k)), np.zeros((symbols, k))
    for s in seqs:
        a, b = [], [np.ones(k)]
        for x in s:
            v = (model.start if not a else a[-1] @ model.move) * model.emit[x]
            want_lik += log(v.sum())
            a.append(v / v.sum())
        for t in range(len(s) - 1, 0, -1):
            below = model.emit[s[t]] * b[0]
            m = np.outer(a[t - 1], below) * model.move
            want_moves += m / m.sum()
            b.insert(0, model.move @ below / (model.move @ below).sum())
        for x, v, w in zip(s, a, b):
            want_emits[x] += v * w / (v @ w)
    full = np.zeros((symbols, k))
    full[seen] = emits
    assert isclose(lik, want_lik, rel_tol=1e-12) and isclose(start.sum(), len(seqs))
    assert np.allclose(moves, want_moves) and np.allclose(full, want_emits)
    model.emit[0] = 0  # cannot be told: scaled at each step
    assert model.stride() == 1


def test_sequences_alike_in_length_run_together(monkeypatch):
    monkeypatch.setattr(H, "TOGETHER", 3000)
    sizes = [1000, 3, 4, 5, 1000, 2, 1, 6] * 5
    parts = [*H.grouped(np.full(n, i) for i, n in enumerate(sizes))]
    assert sorted(p for places, _ in parts for p in places) == [*range(len(sizes))]
    assert all(len(s) == sizes[p] and set(s) == {p} for part in parts for p, s in zip(*part))
    assert sum(max(map(len, seqs)) for _, seqs in parts) <= 5000  # 10,000 in the order they come
    monkeypatch.setattr(H, "WINDOW", 500)
    assert [p for places, _ in H.grouped(np.zeros(n) for n in sizes) for p in places] != [*range(len(sizes))]
    assert [*H.grouped([])] == []


def test_words_of_many_texts_are_split_as_one_by_one():
    texts = ["", " ", "a", " A  b ", "A\x1cb\x85c\xa0d\t\n\x0b\x0c\re É", "\n", "K\u212a İ ﬁ", "x" * 300, "a"]
    for part in ([texts], [texts[:4], texts[4:]], [["b", *texts]]):
        for t in part:
            words, at = H.split_words(H.pa.array(["cut", *t]).slice(1))
            got = [[*map(str.encode, words.to_pylist()[a:b]), H.END] for a, b in zip(at, at[1:])]
            assert got == [spec_tokens(x) for x in t]
    rows = H.pa.array(texts)
    for size in (1, 70, 200, 10_000):
        assert [x for _, p in H.slices(rows, size) for x in p.to_pylist()] == texts


@pytest.fixture(scope="module")
def scored(spark, docs):
    got = H.score_language(docs, "doc_id", "text", remainder("doc_id", 7) == 2, SMALL)
    return {r.doc_id: r for r in got.collect()}


def test_counts_and_base_score(docs, scored):
    rows = {r.doc_id: spec_tokens(r.text) for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in rows}
    counts = Counter(w for d, t in rows.items() if not held[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(scored) == len(rows)
    for d, t in rows.items():
        r = scored[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(t), n)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert isclose(r.base_score, sum(log10((counts[w] + 1) / (n + v + 1)) for w in t),
                       rel_tol=1e-9)


def test_the_model_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_of_a_bucket_share_its_mass(spark, docs):
    """In-bucket probabilities of all training words and one unknown word sum to 1."""
    words = H.count_words(docs.selectExpr("coalesce(text, '') AS _text")).cache()
    voc = H.Vocabulary(words, SMALL)
    table, mass = H._Words(voc), defaultdict(float)
    for r in words.collect():
        s, known, _, inside, rare = table[bytes(r.word)]
        if s > SMALL.frequent:
            size = voc.counts[s] + voc.types[s] + 1
            mass[s] += (r.c + 1) / size if rare else 10 ** inside
    assert all(isclose(m + 1 / (voc.counts[s] + voc.types[s] + 1), 1, rel_tol=1e-9)
               for s, m in mass.items())


def test_odd_rows_are_scored(spark, odd, empty):
    rows = H.score_language(odd, "doc_id", "text", remainder("doc_id", 7) == 2, SMALL).collect()
    assert len(rows) == odd.count()
    assert [r.n_tokens for r in rows if r.doc_id == 0] == [1]
    assert all(np.isfinite([r.score, r.base_score]).all() for r in rows)
    assert H.score_language(empty, "doc_id", "text", remainder("doc_id", 7) == 2,
                            SMALL).collect() == []


# --- URLs -------------------------------------------------------------------------

URLS = ["https://www.Example.NET/en/5?x=1", "http://net", "http://a.net/", "ftp://x.example.com/de/9#f",
        "https://example.org/fr/", "https://notexample.net.org/fr", "no scheme/", None, "", "://",
        "http://B.example.com/de", "http://example.com/en/7/a://b", "https://h?://q", "http://net/en/",
        "http://ex.net/EN/3", "http://日本.org/fr/é\nx", "http://example.net/en/4", "http://b.org/fr/2"]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for rule, verdict in U.RULES:
        h, p = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return best


def model_ratio(texts, labels):
    """Mean log ratio per text by direct counting with the same interpolation."""
    n = U.ORDER
    counts = {c: Counter() for c in (0, 1)}
    for t, label in zip(texts, labels):
        if label is not None:
            for i in range(n, len(t)):
                for k in range(n + 1):
                    counts[label][t[i - k:i], t[i]] += 1
                    counts[label][t[i - k:i], None] += 1

    def p(c, ctx, ch):
        out = 1 / len(U.ALPHABET)
        for k in range(n + 1):
            sub = ctx[n - k:]
            out = (counts[c][sub, ch] + U.STRENGTH * out) / (counts[c][sub, None] + U.STRENGTH)
        return out
    return [np.mean([log(p(1, t[i - n:i], t[i])) - log(p(0, t[i - n:i], t[i]))
                     for i in range(n, len(t))]) for t in texts]


def fold(url):
    text = re.sub("[^a-z0./:?#&=%+_-]", U.OTHER, re.sub("[0-9]", "0", (url or "").lower()))
    return U.START * U.ORDER + text + U.END


@pytest.mark.parametrize("broadcast", [U.MOST_BROADCAST, 0])
def test_urls_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(U, "MOST_BROADCAST", broadcast)
    pages = [*enumerate(URLS), (3, URLS[3]), (None, URLS[2])]
    pages += [(100 + r.page_id, r.url) for r in
              spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in pages],
                               "page_id long, url string, host string, _row int")
    got = U.judge_urls(df).collect()
    assert len(got) == len(pages)
    found = {(r.page_id, r.host, r.path): r for r in got}
    texts, labels = [], []
    for _, u in pages:
        host, path = parsed(u)
        rule = rule_of(host, path)
        texts.append(fold(u))
        aside = zlib.crc32(texts[-1].encode()) % 5 == 0
        labels.append(None if rule is None or aside else int(rule[1] == "allow"))
    for (i, u), ratio in zip(pages, model_ratio(texts, labels)):
        host, path = parsed(u)
        r, rule = found[i, host, path], rule_of(host, path)
        assert r.rule == (rule[0] if rule else None)
        assert isclose(r.ratio, ratio, rel_tol=1e-6, abs_tol=1e-9), u
        assert r.verdict == (rule[1] if rule else "allow" if r.ratio >= r.threshold else "block")


def test_urls_that_differ_in_their_query_only(spark):
    urls = ["http://a.x/p?q=1", "http://a.x/p?viagra=casino&z=zzzz", "http://a.x/p#top", "plain", "other text"]
    rows = [*enumerate(urls), *((100 + i, f"http://h{i}.net/a?buy={'casino' * (i % 3)}") for i in range(40)),
            *((200 + i, f"http://h{i}.org/fr/b?lang=fr&p={i}") for i in range(40))]
    got = {r.page_id: r for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len({got[i].ratio for i in range(5)}) == 5
    assert all((got[i].host, got[i].path) == ("a.x", "/p") for i in range(3))
    assert all((got[i].host, got[i].path) == ("", "") for i in (3, 4))


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(none).collect() == []
    one = spark.createDataFrame([(1, None)], "page_id long, url string")
    assert [(r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(one).collect()] == \
        [("", "", None, "allow")]
