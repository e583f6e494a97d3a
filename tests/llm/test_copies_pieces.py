"""op3, op6, op9 and op10 against brute force, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import SF_MID, SF_SMALL, docs, empty, odd  # noqa: F401
from pyspark.sql import functions as F

from ratelens.llm import jaccard_join as J
from ratelens.llm import pieces as P
from ratelens.llm import spotsigs as S
from ratelens.llm.radix import drop_exact_copies, exact_groups
from ratelens.llm.tokens import public_tokenizer

# --- op3 ----------------------------------------------------------------------------


def check_groups(df):
    rows, got = df.collect(), exact_groups(df).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert Counter((r.doc_id, r.text_sha256) for r in got) == \
        Counter((d, h) for h, members in ids.items() for d in members)
    for r in got:
        known = [d for d in ids[r.text_sha256] if d is not None]
        assert r.group_size == len(ids[r.text_sha256])
        assert r.keep_id == (max(known) if known else None)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(ids)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups(spark, docs, odd, empty):
    check_groups(docs)
    check_groups(odd)
    assert exact_groups(empty).collect() == []


def test_texts_that_differ_late(spark):
    """Common beginnings of every level's width, equal lengths, one huge group of copies."""
    long = "ab" * 20_000
    texts = [long, long[:-1] + "x", long[:1500] + "é" + long[1502:], long[:70], "b" * 70, *["same"] * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_groups(df.unionByName(df.limit(4)).repartition(5))


def test_kept_rows_keep_their_columns(odd):
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == \
        sorted({r.text or "" for r in odd.collect()})


# --- op6 ----------------------------------------------------------------------------


def sigs(text):
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    found = set()
    for i, x in enumerate(w):
        after = [y for y in w[i + 1:] if y not in S.ANCHORS][:2]
        if x in S.ANCHORS and len(after) == 2:
            found.add((x, *after))
    if found or not w:
        return found
    return {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_next_and_edited_documents(docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in S.compare_with_next(docs).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        x = got[r.doc_id]
        assert x.n_chars == len(text)
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(x.fingerprint) == 8 * len(sigs(text))
        assert abs(x.near_edited - jaccard(sigs(text), sigs(edited))) < 1e-9
        assert abs(x.near_next - jaccard(sigs(text), sigs(after))) < 1e-9


def test_odd_fingerprints(spark, odd, empty):
    rows, got = odd.collect(), S.compare_with_next(odd).collect()
    assert len(got) == len(rows)
    by_chars = defaultdict(set)
    for r in got:
        by_chars[r.doc_id, r.n_chars].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_chars.values())
    same = {next(iter(by_chars[i, 15])) for i in (4, 5)}
    assert len(same) == 1  # equal texts, equal fingerprints
    assert S.compare_with_next(empty).collect() == []
    one = S.compare_with_next(odd.where("doc_id = 4").limit(1)).first()
    assert one.near_next == 1.0


def test_similar_pairs_lose_nothing(docs):
    first = {}  # documents of one fingerprint meet as one
    for r in docs.collect():
        x = frozenset(sigs(r.text or ""))
        first[x] = min(first.get(x, r.doc_id), r.doc_id)
    known = {d: x for x, d in first.items()}
    ids = sorted(known)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
            if known[a] and jaccard(known[a], known[b]) >= 0.4}
    got = {tuple(sorted((r.left_id, r.right_id))): r.likeness
           for r in S.similar_pairs(docs, least=0.4).collect()}
    assert set(got) == want
    assert all(abs(got[a, b] - jaccard(known[a], known[b])) < 1e-9 for a, b in want)


# --- op9 ----------------------------------------------------------------------------


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def check_join(df, settings=J.Settings(), recall=1.0):
    df = df.withColumn("at", F.monotonically_increasing_id()).cache()
    at = {r.at: r for r in df.collect()}
    found = J.near_classes(df, "at", settings=settings).collect()
    assert len(found) == len(at)
    sets = {i: shingles(r.text) for i, r in at.items()}
    owners = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    links, parent = Counter(), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, s in sets.items():
        shared = Counter(j for x in s for j in owners[x] if j > i)
        for j, c in shared.items():
            if c >= 0.8 * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r._id: r for r in found}
    assert sum(r.n_links for r in found) >= recall * sum(links.values())
    assert all(r.n_links <= links[i] for i, r in got.items())
    if recall == 1.0:
        assert all(r.n_links == links[i] for i, r in got.items())
        classes = defaultdict(set)
        for i in sets:
            classes[root(i)].add(got[i].class_row)
        assert all(len(c) == 1 for c in classes.values())
        assert len({r.class_row for r in found}) == len(classes)


def test_join_equals_brute_force(docs, odd):
    check_join(docs)
    check_join(odd.coalesce(1))


def near_copies(spark, n):
    """n near copies of one text, n texts that share half of theirs, and unrelated ones."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for _ in range(n):
        w = list(base)
        w[rnd.randrange(150)] = word()
        rows.append(" ".join(w))
        rows.append(" ".join(base[:75] + [word() for _ in range(75)]))
        rows.append(" ".join(word() for _ in range(60)))
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)


def test_large_buckets_are_split_and_finished(spark):
    """Buckets of 8 and tiles of 16 members: paths, pivots and cross tiles all take part."""
    check_join(near_copies(spark, 60), J.Settings(bucket=8, depth=2, tile_members=16))


def test_recall_of_pairs_at_the_limit(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(94)]
        other = w[:84] + [f"v{rnd.randrange(10**6)}" for _ in range(10)]  # 80 of 100 shared: 0.8
        rows += [" ".join(w), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    check_join(df, recall=0.97)


def test_large_families_of_near_copies_are_whole(spark):
    """16 families of 300 texts, each with one word of its own: all alike, buckets far above 128."""
    rnd = random.Random(6)
    rows = []
    for family in range(16):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
        for i in range(300):
            at = rnd.randrange(150)
            rows.append((family, " ".join([*base[:at], f"own{family}x{i}", *base[at + 1:]])))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, row struct<family: int, text: string>")
    got = J.near_classes(df.select("doc_id", "row.text")).collect()
    assert {r._id: r.n_links for r in got} == {i: 299 for i in range(len(rows))}
    assert len({r.class_id for r in got}) == 16


def test_recall_of_pairs_that_share_hot_passages(spark):
    """Pairs whose shared shingles are all in some 100 texts: met at deep levels only."""
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        pick = rnd.sample(range(50), 9)
        rows += [" ".join(f"{' '.join(f'p{p}x{j}' for j in range(50))} own{i}{side}{p}" for p in pick)
                 for side in "ab"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(4)
    check_join(df, J.Settings(bucket=8), recall=0.99)
    assert J.Settings().runs == 7 and J.Settings(recall=0.9999).runs > 7 > J.Settings(recall=0.9).runs


def test_pivots_keep_both_ends_of_a_pair_together(spark):
    """x and y are 0.8 alike; x is like the pivots and leaves, y is not: y is linked to them or x stays."""
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 60_000, J.BINS).astype(np.uint16)

    def other(s, lo, hi):
        s = s.copy()
        s[lo:hi] = rnd.integers(0, 60_000, hi - lo)
        return s.tobytes()
    rows = [(1, i, base.tobytes(), 40) for i in range(40)]
    for i in range(40):
        x = np.frombuffer(other(base, 0, 23), np.uint16)  # 41 of 64 places like the pivots
        rows += [(1, 1000 + i, x.tobytes(), 40), (1, 2000 + i, other(x, 23, 36), 40)]  # 28 of 64
    big = spark.createDataFrame(rows, "key long, rep long, sketch binary, size long")
    pivots = {i for i in range(3000) if i < 40}
    judged = J._pivot_round(big, J.Settings(), 40, 1, pick=F.col("rep") < 40).collect()
    linked = {r.rep for r in judged if r.pivot in pivots}
    stays = {r.rep for r in judged if r.sketch is not None}
    assert linked >= pivots and not stays & pivots
    assert all({1000 + i, 2000 + i} <= linked or {1000 + i, 2000 + i} <= stays for i in range(40))


def templated(n, seed, shared=100, own=70):
    """n texts on one template: about ``shared`` common words, own words between them; a
    tenth has a near copy."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        text = base + [f"o{i}x{rnd.randrange(10**6)}" for _ in range(own)]
        rows.append(" ".join(text))
        if i % 10 == 0:
            rows.append(" ".join(text[:-3] + ["near", "copy", str(i)]))
    return rows


def test_texts_on_one_template_are_taken_apart(spark, monkeypatch):
    """2,000 texts, 0.4 alike, and near copies of 200: links are those of the copies, and sets
    are compared with few others."""
    rows = templated(2000, 3)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    seen = []
    plain = J.exact_links
    monkeypatch.setattr(J, "exact_links", lambda members, set_: seen.append(
        members.groupBy("root").count().toPandas()["count"]) or plain(members, set_))
    check_join(df, J.Settings(tiles=1))
    assert (seen[0] ** 2).sum() < 2000 * 20


def test_prefix_keys_bring_all_pairs_together(spark):
    rnd = random.Random(9)
    sets = []
    for i in range(200):
        a = rnd.sample(range(400), rnd.randrange(1, 30))
        sets += [a, [x for x in a if rnd.random() < 0.95] + rnd.sample(range(400, 440), rnd.randrange(3))]
    sets = [np.array(sorted(set(x)), "<u4") for x in sets]
    rows = [(i % 2, i, len(x), x.tobytes()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "root long, rep long, n int, tokens binary")
    held = defaultdict(set)
    for r in J.prefix_keys(df, J.Settings()).collect():
        held[r.rep].add(r.key)
    for i, a in enumerate(sets):
        for j in range(i + 2, len(sets), 2):
            both = len(np.intersect1d(a, sets[j]))
            if both and both >= 0.8 * (len(a) + len(sets[j]) - both):
                assert held[i] & held[j], (i, j)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), *((i, 100) for i in range(50, 99))],
                                  "a long, b long")
    nodes, _ = J.components(links)
    got = {r.node: r.root for r in nodes.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{i: 50 for i in range(50, 99)}, 100: 50}


def test_join_of_no_rows_and_kept_columns(empty, odd):
    assert J.jaccard_join(empty).collect() == []
    kept = J.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() < odd.count()


# --- op10 ---------------------------------------------------------------------------

PATH = public_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The sentencepiece library with the same vocabulary and scores as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    voc = P.vocabulary(PATH)
    for p in model.pieces:
        if p.type == 1:
            p.score = voc.score[p.piece] / (1 << 24)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_words_equal_the_library(library, docs):
    voc = P.vocabulary(PATH)
    words = {w for r in docs.collect() for w in (r.text or "").split()}
    for w in sorted(words)[:4000]:
        ids = np.frombuffer(voc.path(P.marked(w), 0, len(w) + 1, len(w) + 1)[0], "<u4").tolist()
        # the same pieces in another order ("%" "%%") score the same
        assert sorted(ids) == sorted(library.encode(w)), w


def test_unseen_words_are_segmented_together(docs, monkeypatch):
    """In one call for all, not by the recursion word by word, and as the recursion does."""
    plain, voc, rnd = P.Vocabulary(PATH), P.Vocabulary(PATH), random.Random(5)
    odd = ["the", " ", "  ", P.MARK, "漢", "🙂", "\n", "é", "%%", "<0x0A>", "<unk>", "<s>", "\ue000", "\ue001",
           "x" * 300, "ﬁ", "abc"]
    texts = [r.text or "" for r in docs.limit(200).collect()]
    texts += ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 30))) for _ in range(1000)]
    walked = []
    walk = voc.path
    monkeypatch.setattr(voc, "path", lambda s, *rest: walked.append(s) or walk(s, *rest))
    words = [P.words_of(t) for t in texts]
    voc.learn(set().union(*words))
    assert not walked
    for t, w in zip(texts, words):
        found = [plain.words[x] for x in re.findall(f"{P.MARK}+[^{P.MARK}]*", P.marked(t))]
        assert voc.row(w) == b"".join(ids for ids, _ in found), t
        assert voc.value(voc.row(w)) == sum(score for _, score in found), t
    assert all(len(s) > 256 or not s.strip(P.MARK) for s in walked)  # long words, and marks alone


def test_a_worker_that_decodes_keeps_no_words():
    voc = P.Vocabulary(PATH)
    voc.learn({"the", "unseen\n"})
    ids = voc.row(["the", "unseen\n"])
    voc.words[P.MARK + "other"]
    voc.forget()
    assert not voc.found and not voc.words and not {"steps", "_row"} & set(vars(voc))
    assert voc.decode(ids) == "▁the▁unseen\n" and voc.row(["the", "unseen\n"]) == ids


def test_words_that_leave_a_full_table(monkeypatch):
    monkeypatch.setattr(P, "WORDS", 20)
    voc, plain = P.Vocabulary(PATH), P.Vocabulary(PATH)
    for k in range(30):
        words = [f"w{(k * 7 + i) % 40}\n" for i in range(25)]
        voc.learn(set(words))
        assert voc.row(words) == b"".join(plain.words[P.MARK + w][0] for w in words)
        assert len(voc.found) <= 10


TEXTS = ["the", "re", " ", "  ", "tion", "x", "漢", "🙂", "abcab", "internationalization", "é", "\n"]


def test_chunks_equal_the_whole():
    voc, rnd = P.vocabulary(PATH), random.Random(1)
    for _ in range(150):
        s = P.marked("".join(rnd.choice(TEXTS) for _ in range(rnd.randint(1, 60))))
        size = rnd.choice([17, 20, 33])
        count = max(1, -(-len(s) // size))
        count -= count > 1 and len(s) - (count - 1) * size < voc.longest
        ends = [(k + 1) * size for k in range(count - 1)] + [len(s)]
        chunks = [P.Chunk(voc, (s[a - 1] if a else P.MARK) + s[a:b + voc.longest - 1], b - a)
                  for a, b in zip([0, *ends], ends)]
        matrices = [c.matrix() for c in chunks]
        whole, score = voc.path(s, 0, len(s), len(s))
        left = right = matrices[0]
        for m in matrices[1:]:
            left = P.product(left, m)
        right = matrices[-1]
        for m in matrices[-2::-1]:
            right = P.product(m, right)
        assert left[0, 0] == right[0, 0] == score
        states = [0, *P.between(matrices, 0, 0), 0]
        assert b"".join(c.ids(e, x) for c, e, x in zip(chunks, states, states[1:])) == whole


def test_documents_round_trip(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3)  # several levels of combination
    voc = P.vocabulary(PATH)
    for df in (docs, odd):
        encoded = P.encode_documents(df, PATH, chunk=64).cache()
        texts, pieces = Counter(), Counter()
        for r in df.collect():
            text = r.text or ""
            ids = b"".join(voc.words[w][0] for w in
                           re.findall(f"{P.MARK}+[^{P.MARK}]*|^[^{P.MARK}]+", P.marked(text)))
            texts[r.doc_id, len(ids) // 4, len(text), zlib.crc32(text.encode())] += 1
            # pieces in another order ("%" "%%") score the same
            pieces[r.doc_id, tuple(sorted(np.frombuffer(ids, "<u4").tolist()))] += 1
        got = P.digest_documents(encoded, PATH).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_chars, r.text_crc32) for r in got) == texts
        assert max(r.n_chunks for r in got) > 27
        rows = defaultdict(list)
        for r in sorted(encoded.collect(), key=lambda r: r.k):
            rows[r._row, r.doc_id].append(bytes(r.ids))
        assert Counter((d, tuple(sorted(np.frombuffer(b"".join(x), "<u4").tolist())))
                       for (_, d), x in rows.items()) == pieces
        crcs = Counter((d, zlib.crc32(b"".join(x))) for (_, d), x in rows.items())
        assert Counter((r.doc_id, r.ids_crc32) for r in got) == crcs
    assert P.digest_documents(P.encode_documents(empty, PATH), PATH).collect() == []


def test_digests_move_no_ids_and_texts(docs, odd):
    """Between the tasks' Python and the shuffle there are numbers only."""
    for df in (docs, odd):
        encoded = P.encode_documents(df, PATH, chunk=64)
        plan = P.digest_documents(encoded, PATH)._jdf.queryExecution().analyzed().toString()
        assert not re.search(r"\b(text|plain)#", plan) and "translate" not in plan
        texts = P.decode_chunks(encoded, PATH).collect()
        sums = P.decode_chunks(encoded, PATH, sums=True)
        assert sums.columns == ["_row", "doc_id", "k", "chunks", "ids_bytes", "ids_crc", "text_bytes",
                                "text_crc", "chars"]
        expected = Counter()
        for r in texts:
            text = (r.text[1:] if r.k == 0 else r.text).replace(P.MARK, " ")
            expected[r._row, r.k, len(r.ids), zlib.crc32(r.ids), len(text.encode()),
                     zlib.crc32(text.encode()), len(text)] += 1
        assert Counter((r._row, r.k, r.ids_bytes, r.ids_crc, r.text_bytes, r.text_crc, r.chars)
                       for r in sums.collect()) == expected


def test_lengths_around_chunk_borders(spark, library):
    """Every length from two below one and two chunks to twice the longest piece beyond."""
    voc, chunk = P.vocabulary(PATH), 64
    text = ("the international re-organization of 漢字 words  " * 9).replace("  ", " ")
    # the marked text has one character more
    lengths = [n - 1 for c in (chunk, 2 * chunk) for n in range(c - 2, c + 2 * voc.longest + 1)]
    df = spark.createDataFrame([(n, text[:n]) for n in lengths], "doc_id long, text string")
    encoded = P.encode_documents(df, PATH, chunk=chunk).cache()
    got = {r.doc_id: r for r in P.digest_documents(encoded, PATH).collect()}
    assert len(got) == len(set(lengths))
    rows = defaultdict(list)
    for r in sorted(encoded.collect(), key=lambda r: r.k):
        rows[r.doc_id].append(bytes(r.ids))
    for n in lengths:
        assert (got[n].n_chars, got[n].text_crc32) == (n, zlib.crc32(text[:n].encode()))
        ids = np.frombuffer(b"".join(rows[n]), "<u4").tolist()
        assert ids == library.encode(text[:n]), n
    whole = spark.createDataFrame([(n, "word " * 9000 + "x" * (n % 5)) for n in range(5)], "doc_id long, text string") \
        .selectExpr("doc_id", f"substring(text, 1, int({P.CHUNK} - 3 + 6 * doc_id)) AS text")
    found = P.digest_documents(P.encode_documents(whole, PATH), PATH).collect()
    assert sorted(r.n_chars for r in found) == [P.CHUNK - 3 + 6 * n for n in range(5)]


# --- pipeline -----------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as C
    from ratelens.llm.common import written
    from ratelens.llm.quality import score_quality, train
    from ratelens.llm.secrets import all_spans
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join",
                                        "secret scans", "packing"]
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    tables = [docs]
    for _, stage in C.STAGES:
        tables.append(written(stage(spark, tables[-1], SF_MID))[0])
    raw, good, single, apart, clean, packed = (t.collect() for t in tables)
    assert all(t.columns == docs.columns for t in tables[1:5])
    weights = train(docs, spark.read.parquet(f"{SF_MID}/labels.parquet"))
    accepted = {r.doc_id for r in score_quality(docs, weights).where("score >= 0.5").collect()}
    assert {r.doc_id for r in good} == accepted
    best = {}
    for r in good:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in single} == set(best.values())
    sets = {r.doc_id: shingles(r.text) for r in single}
    owners = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    near = defaultdict(set)
    for d, s in sets.items():
        for e, c in Counter(e for x in s for e in owners[x] if e != d).items():
            if c >= 0.8 * (len(s) + len(sets[e]) - c):
                near[d].add(e)
    kept = {r.doc_id for r in apart}
    assert all(not near[d] & kept for d in kept)  # one of each class
    assert all(near[d] for d in set(sets) - kept)  # clean documents stay
    texts = {r.doc_id: r.text for r in apart}
    assert {r.doc_id for r in clean} == kept
    for r in clean:
        found = all_spans(texts[r.doc_id] or "")[1]
        assert (r.text == texts[r.doc_id]) == (not found) and r.n_chars == len(r.text)
    assert {r.doc_id for r in packed} == kept and sum(r.length for r in packed) == \
        sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_pipeline_of_no_rows(spark):
    import corpus_pipeline as C
    none = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        none = stage(spark, none, SF_SMALL)
        assert none.collect() == []


def test_prefix_keys_move_no_tokens(spark):
    rows = [(0, i, 3, np.array([1, 2, 10 + i], "<u4").tobytes()) for i in range(4)]
    keys = J.prefix_keys(spark.createDataFrame(rows, "root long, rep long, n int, tokens binary"), J.Settings())
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.rep for r in keys.collect()} <= set(range(4))


def test_buckets_of_the_same_members_are_compared_once(spark):
    rows = [(k, r) for k in (1, 2, 3) for r in (5, 6)] + [(4, 5), (4, 7), (8, 9)]
    sizes = J.buckets_of(spark.createDataFrame(rows, "key long, rep long"))
    assert {(r.key, r["size"]) for r in sizes.collect()} == {(1, 2), (2, 2), (3, 2), (4, 2)}
    assert {r.key for r in J.small_buckets(sizes, 2).collect()} == {1, 4}


def test_rows_that_a_join_would_move_for_nothing_stay(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "rep")
    wanted = rows.where("rep % 1000 = 0")
    kept = {r.rep for r in J.marked(rows, wanted, "rep").collect()}
    assert set(range(0, 20_000, 1000)) <= kept and len(kept) < 200
    assert {r.rep for r in J.marked(rows, wanted, "rep", "left_anti").collect()} == set(range(20_000)) - kept
