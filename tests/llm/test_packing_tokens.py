"""op4 and op7: exact tokens, gapless packing, file round trip."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs, empty, odd  # noqa: F401
from tokenizers import Tokenizer

from ratelens.llm import pfor
from ratelens.llm.packing import Limits, Packer, pack_documents, pack_examples
from ratelens.llm.tokens import encoder, public_tokenizer

PARTS = st.sampled_from(["a", "b ", "é", "  ", "\n", " ", "\t", "'s", "it's ", ",", "12", "ſ", "İ",
                         "Σ", "é", "\x1c", " ", "漢字", "<|endoftext|>", " the", "🙂",
                         "b%%%", "x.***", "the!! ", "Ab"])


def library(name):
    tok = Tokenizer.from_file(public_tokenizer(name))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    ours, theirs = encoder(public_tokenizer(name)).encode, library(name)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(PARTS, max_size=14).map("".join))
    def same(text):
        assert np.frombuffer(ours(text), "<u4").tolist() == theirs(text)
    same()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_runs_and_whole_texts_equal_library(name, docs):
    ours, theirs = encoder(public_tokenizer(name)), library(name)
    assert ours.ranks is not None
    texts = ["x" * 2500, " " * 2500 + "a", "ab" * 3000 + " end", "é" * 1500, "a\x0bb", "a\x85b", "a\xa0b\xad",
             "naïve Œuvre, l'été's", "tab\tand\r\nline  two ", "x" * 1999 + "!" * 30, "1²3½ ﬁ"]
    texts += [r.text for r in docs.collect() if r.text and len(r.text) < 20_000]
    for t in texts:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs(t), t[:80]


def check_packing(pieces, expected, size=2048):
    """Each id in one piece, gapless sequences, full but for powers of two."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    for members in seqs.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length > 0
            at += p.length
        assert at == size or at & (at - 1) == 0
    for doc, ids in expected.items():
        got = sorted(docs[doc], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in got) == b"".join(ids)


def test_documents_are_packed_whole(docs):
    encode = library("byte_bpe_50k.json")
    path = public_tokenizer("byte_bpe_50k.json")
    expected = {r.doc_id: [np.array([*encode(r.text or ""), 1], "<u4").tobytes()]
                for r in docs.collect()}
    check_packing(pack_documents(docs, path).collect(), expected)


def test_odd_documents_are_packed(odd, empty):
    path = public_tokenizer("byte_bpe_50k.json")
    pieces = pack_documents(odd, path).collect()
    encode = library("byte_bpe_50k.json")
    want = sum(len(encode(r.text or "")) + 1 for r in odd.collect())
    assert sum(p.length for p in pieces) == want
    assert {p.doc_id for p in pieces} == {r.doc_id for r in odd.collect()}
    assert pack_documents(empty, path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=300))
def test_whole_examples_respect_all_limits(sizes):
    limits = Limits(tokens=50, segments=4, loss_tokens=30)
    packer, placed = Packer(limits, False, 0), []
    for i, (tokens, loss) in enumerate(sizes):
        placed += packer.add(i, 0, tokens, min(tokens, loss))
    placed += packer.finish()
    assert sorted(p[0] for p in placed) == [i for i, (t, _) in enumerate(sizes) if t]
    seqs = defaultdict(list)
    for key, _, tokens, seq, _ in placed:
        seqs[seq].append((tokens, min(sizes[key])))
    for members in seqs.values():
        if len(members) > 1:
            assert sum(t for t, _ in members) <= 50 and len(members) <= 4
            assert sum(x for _, x in members) <= 30


def test_pack_examples_frame(spark):
    df = spark.createDataFrame([(1, 30, 10), (2, None, 3), (3, 20, 20), (4, 99, 0), (4, 99, 0)],
                               "id long, tokens int, loss int")
    rows = pack_examples(df, "id", "tokens", "loss", Limits(50, 4, 30)).collect()
    assert sorted(r.id for r in rows) == [1, 3, 4, 4]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=3000))
def test_block_round_trip(values):
    ids = np.array(values, "<u4")
    data, heads, starts = pfor.encode_group(ids)
    back = pfor.decode_blocks(data, np.array(heads), np.array(starts))
    assert back.tolist() == ids.tolist()


def test_exceptions_and_widths():
    ids = np.full(1024, 7, np.int64)
    ids[5] = 2**31
    data, heads, starts = pfor.encode_group(ids)
    assert len(data) < 64  # no width for one outlier
    assert pfor.decode_blocks(data, np.array(heads), np.array(starts)).tolist() == ids.tolist()


def test_random_access():
    writer = pfor.FileWriter(3)
    docs = [(i, np.arange(i * 7, i * 7 + 13 * i, dtype="<u4")) for i in range(1, 400)]
    content = b"".join(d + b"\n" for i, ids in docs for d in writer.add(i, ids.tobytes()))
    content += b"".join(d + b"\n" for d in writer.finish())
    r, whole = pfor.FileReader(content), np.concatenate([d for _, d in docs])
    assert r.part == 3 and r.total == len(whole)
    for a, b in ((0, 1), (1000, 3000), (len(whole) - 5, len(whole))):
        assert r.read(a, b).tolist() == whole[a:b].tolist()
    assert [(i, ids.tolist()) for i, _, ids in r.documents()] == [(i, d.tolist()) for i, d in docs]


def files(spark, df, path, **kw):
    pfor.write_documents(df, path, public_tokenizer("word_bpe_49k.json"), **kw)
    return pfor.read_documents(spark, path).collect()


def test_files_hold_every_document(spark, docs, tmp_path):
    encode = library("word_bpe_49k.json")
    got = sorted(files(spark, docs, str(tmp_path / "f"), chars_per_file=100_000),
                 key=lambda r: r.start)
    at = 0
    for row, want in zip(got, sorted(docs.collect(), key=lambda r: r.doc_id)):
        ids = np.array([*encode(want.text or ""), 2], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens) == (want.doc_id, at, len(ids) // 4)
        assert row.ids_crc32 == zlib.crc32(ids) and bytes(row.ids) == ids
        at += len(ids) // 4


def test_odd_files(spark, odd, empty, tmp_path):
    got = sorted(files(spark, odd, str(tmp_path / "o"), chars_per_file=50_000), key=lambda r: r.start)
    assert len(got) == odd.count() and [r.doc_id for r in got[:2]] == [None, None]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert files(spark, empty, str(tmp_path / "e")) == []


def test_words_are_kept_once_however_they_are_written():
    import random
    from ratelens.llm.tokens import Encoder, public_tokenizer
    enc = Encoder(public_tokenizer("word_bpe_49k.json"))
    for text in ("Straße éÉ Foo, foo, FOO,", "ÉÉ straße foo,"):
        assert enc.encode(text) == enc._library(text)
    assert {w for w in enc.words if w.lower() == "foo,"} == {"foo,"}
    rnd = random.Random(3)
    letters = [*" aEi\nS'.<|>", "İ", "ſ", "ŉ", "̇", "́", "Σ", "Å", "É", "ẞ"]
    for _ in range(2000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(30)))
        assert enc.encode(text) == enc._library(text), repr(text)


def test_new_words_of_many_texts_are_merged_together(monkeypatch):
    """Letters followed by marks go to no call of their own, and all ids are the library's."""
    import random
    from ratelens.llm.tokens import Encoder
    enc, rnd = Encoder(public_tokenizer("word_bpe_49k.json")), random.Random(3)
    called = []
    piece = enc._piece
    enc.pieces._compute = lambda p: called.append(p) or piece(p)
    plain = [" ".join(f"{rnd.choice('abcé')}x{rnd.choice(['the', 'ought', 'İ'])}{rnd.choice(['', ',', '!?'])}".replace("x", w)
                      for w in ("st", "rr", "Nd", "oo")) for _ in range(300)]
    odd = ["the", "Foo", "É", "İ", "ß", "\0", "a\0b", " ", "  ", "\n", "漢", "🙂", "'s", "don't", "<|endoftext|>",
           "x<|", "!!", ",", "1", "2a", "é", "ﬁ", "x" * 300, "y" * 3000, "Å", "\xff", "ſ"]
    mixed = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    assert enc.encode_many(["Foo, bar! été", ""]) and not called
    for texts in (plain, mixed, plain + mixed):
        assert enc.encode_many(texts) == [enc._library(t) for t in texts]
    enc = Encoder(public_tokenizer("word_bpe_49k.json"))
    enc.words._size = 5  # a table that cannot hold the words of one call
    assert enc.encode_many(plain) == [enc._library(t) for t in plain]
    assert len(enc.words) <= 5


def test_a_word_is_looked_up_once_for_many_texts(monkeypatch):
    from ratelens.llm.tokens import Encoder, Generations
    enc, asked = Encoder(public_tokenizer("word_bpe_49k.json")), []
    monkeypatch.setattr(Generations, "get", lambda self, w: asked.append(w) or dict.get(self, w), raising=False)
    texts = ["the Cat and the cat", "", " ", "\n", "the  cat\tand\nCAT \0 ", "été " * 50, "x" * 300 + " the " + "x" * 300]
    for some in (texts, texts[1:4], [""], []):
        asked.clear()
        assert enc.encode_many(some) == [enc._library(t) for t in some]
        assert len(asked) == len(set(asked))
    assert enc.encode_many([texts[0]] * 3) == [enc.encode(texts[0])] * 3


def test_known_words_cost_less_than_a_lookup_of_each():
    """Many texts together take a third of what splitting and looking up word by word takes (twice as much before)."""
    import random
    import time
    from ratelens.llm.tokens import Encoder
    enc, rnd = Encoder(public_tokenizer("word_bpe_49k.json")), random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(100_000)]
    texts = [" ".join(rnd.choices(words, k=500)) for _ in range(1000)]

    def one_by_one(some):
        return [b"".join(map(enc.words.__getitem__, t.split(" "))) for t in some]

    def seconds(f):
        taken = []
        for _ in range(3):
            start = time.process_time()
            f(texts)
            taken.append(time.process_time() - start)
        return min(taken)

    assert enc.encode_many(texts) == one_by_one(texts)  # all words are known from here on
    assert seconds(enc.encode_many) < seconds(one_by_one)


def test_a_worker_drops_what_an_earlier_stage_kept():
    from ratelens.llm import common
    common.resident("some table", lambda: {"a": 1})
    common.release()
    assert not common._RESIDENT and common.resident("some table", dict) == {}
