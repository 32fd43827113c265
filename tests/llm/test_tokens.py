import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lodestone.llm import packing, tokens, wavelet
from lodestone.llm.tokens import ChunkEncoder, tokenizer_file

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "it's  we'll\tgo", "x y  z", "<|endoftext|> a<|endoftext|>",
    "é ñ 你好 12 345", "a" * 5000, " ".join("w%d" % i for i in range(300)), "a\x1c b \x1c c", "tab\t tab", "  x  y", "end\n",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_chunks_equal_whole_texts(library):
    encoder, rng = ChunkEncoder(tokenizer_file()), random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\tabé!'s1　") for _ in range(rng.randrange(60))) for _ in range(400)]
    for _ in range(2):
        for x in texts:
            assert np.frombuffer(encoder.encode(x), "<u4").tolist() == library(x), repr(x)


def test_line_ends_letters_and_small_stores(library, monkeypatch):
    monkeypatch.setattr(tokens, "STORE", 40)
    monkeypatch.setattr(tokens, "PART", 60)
    encoder, rng = ChunkEncoder(tokenizer_file()), random.Random(5)
    kinds = [" \n ab", "\n a.b", " \n\tab\r", "é \nñçœÿªµº×÷ x", "\xa0 \n\x85a\x1cЖ字 ", " \n\xa0Ж"]
    texts = ["".join(rng.choice(kinds[i % 6]) for _ in range(rng.randrange(40))) for i in range(3000)]
    texts += ["one.\nTwo, three.\nOne", "a\n\nb \nc", " \n\n\nb", "x" * 100 + "\n" + "y" * 100 + " z", *ODD]
    got = list(encoder.encode_each(texts))
    assert len(got) == len(texts)
    for x, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library(x), repr(x)


def test_store_of_an_encoder_bounds_a_generation():
    encoder = tokens.encoder_for(tokenizer_file(), 30)
    assert encoder is tokens.encoder_for(tokenizer_file(), 30) and encoder is not tokens.encoder_for(tokenizer_file())
    for i in range(40):
        encoder.encode("a " + " ".join(f"w{i}x{j}" for j in range(10)))
        assert len(encoder.store) <= 40 and len(encoder.older) <= 40


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode_batch_fast(self, *args, **more):
        self.calls += 1
        return self.tokenizer.encode_batch_fast(*args, **more)


def test_new_words_of_many_texts_share_calls(library):
    """A call of the library a text, with its pattern, was most of the time of op3 and op10."""
    encoder = ChunkEncoder(tokenizer_file())
    encoder.tokenizer, encoder.words = Counted(encoder.tokenizer), Counted(encoder.words)
    letters = "abcdeéß"
    texts = ["In " + " ".join(letters[i % 7] + letters[i // 7 % 7] + letters[i // 49 % 7] + letters[j] for j in range(7)) + ".\nIn it" for i in range(343)]
    for x, ids in zip(texts, encoder.encode_each(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(x)
    assert encoder.tokenizer.calls + encoder.words.calls < 10


class Noted:
    def __init__(self, tokenizer, texts):
        self.tokenizer, self.texts = tokenizer, texts

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_new_words_in_short_strings(library):
    """The library's time on one long string of new words, and a word anew for each mark behind it, were most of the time of op10."""
    encoder, given = ChunkEncoder(tokenizer_file()), []
    encoder.tokenizer, encoder.words = Noted(encoder.tokenizer, given), Noted(encoder.words, given)
    words = ["".join("abcdeéß"[i // 7**k % 7] for k in range(4)) for i in range(7**4)]
    texts = ["In " + " ".join(w + mark for w in words) for mark in ("", ",", "...")]
    for x, ids in zip(texts, encoder.encode_each(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(x)
    assert max(map(len, given)) < 1000 and sum(map(len, given)) < 20_000


def test_columns_equal_whole_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 90)
    monkeypatch.setattr(tokens, "LUMP", 3)
    monkeypatch.setattr(tokens, "CALL", 2)
    encoder, rng = ChunkEncoder(tokenizer_file(), 50), random.Random(8)
    kinds = [" \nab,.'", " é×÷,ñ-!à ", " \n\t\r\x0b\x1c\x85\xa0a.", " \u3000\u2003\u1680\u2028\ufeffa,é", "e\u0301,\u0303 a.\u200b", " a1,2.é3'sll ", " Жя,你。😀!a", "'sdtmrevl \n"]
    texts = ["".join(rng.choice(kinds[i % 8]) for _ in range(rng.randrange(30))) for i in range(4000)] + ODD + ["", None, ""]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["left out", *texts], kind).slice(1)
        got = [ids[a:b].tolist() for ids, ends in encoder.encode_column(column) for a, b in zip(ends, ends[1:])]
        assert len(got) == len(texts)
        for x, ids in zip(texts, got):
            assert ids == library(x), repr(x)
    assert list(encoder.encode_column(pa.array([], pa.string()))) == []


def test_pieces_that_join_words():
    """Where a piece reaches over a space, words keep the pattern."""
    made = Tokenizer(models.BPE({"a": 0, "b": 1, "Ġ": 2, "Ċ": 3, "aĠ": 4, "aĠb": 5, "Ġb": 6}, [("a", "Ġ"), ("aĠ", "b"), ("Ġ", "b")]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    encoder = ChunkEncoder(made.to_str())
    assert encoder.words is None and ChunkEncoder(tokenizer_file()).words is not None
    for x in ("a b a b", "b a b\na b", "ab ba\nab"):
        assert np.frombuffer(encoder.encode(x), "<u4").tolist() == made.encode(x).ids


@pytest.mark.parametrize("seed", range(6))
def test_packing_core(seed):
    lengths = np.random.default_rng(seed).integers(1, 6000, 200)
    pieces = packing.pack_lengths(lengths)
    by_item, by_sequence = {}, {}
    for item, start, n, sequence, offset in pieces:
        assert n > 0
        by_item.setdefault(item, []).append((start, n))
        by_sequence.setdefault(sequence, []).append((offset, n))
    for i, total in enumerate(lengths):
        at = 0
        for start, n in sorted(by_item[i]):
            assert start == at
            at += n
        assert at == total
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_sequence) == -(-int(lengths.sum()) // 2048)


def test_packing_query(spark, library):
    rows = [(i, x, "extra") for i, x in enumerate(ODD)] + [(3, " ", "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = packing.pack_documents(df, tokenizer_file()).collect()
    again = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.sequence_id)):
        again.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, x in enumerate(ODD):
        want = library(x) + [1]
        if i == 3:  # two documents have this id: each id of either at its place
            placed = [(len(w), at, v) for w in (want, library(" ") + [1]) for at, v in enumerate(w)]
            pieces = [(r.doc_tokens, r.start + at, v) for r in out if r.doc_id == 3 for at, v in enumerate(np.frombuffer(r.ids, "<u4").tolist())]
            assert sorted(pieces) == sorted(placed)
            continue
        got = b"".join(r.ids for r in sorted(again[i, len(want)], key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == want
    taken = {}
    for r in out:
        assert r.length * 4 == len(r.ids)
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in taken.values():  # gapless from 0, at most 2048
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    digest = lambda r: (r.doc_id or -1, r.doc_tokens, r.start, r.length)
    want = sorted((*digest(r), zlib.crc32(r.ids)) for r in out)
    assert sorted((*digest(r), r.ids_crc32) for r in packing.packed(df).collect()) == want
    assert packing.packed(df.limit(0)).count() == 0


def test_wavelet_core():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (9, 2), (3000, 50000), (1500, 70000), (8 * wavelet.BLOCK, 9), (200_000, 700)):
        ids = rng.integers(0, top, n)
        m = wavelet.WaveletMatrix(wavelet.write_matrix(ids, np.array([5]), np.array([n])))
        assert (m.tokens() == ids).all()
        for i in rng.integers(0, max(n, 1), 20 if n else 0):
            t = int(ids[i])
            assert m.access(int(i)) == t
            assert m.count(t) == (ids == t).sum() and m.count(t, int(i)) == (ids[:i] == t).sum()
            places = np.flatnonzero(ids == t)
            assert m.occurrences(t) == places.tolist() and m.select(t, len(places) // 2) == places[len(places) // 2]
        assert m.count(1 << 20) == 0
    m = wavelet.WaveletMatrix(wavelet.write_matrix(ids, np.array([5]), np.array([n])))
    assert m.access(123_456) == ids[123_456] and len(m.inflated) <= m.bits < m.bits * m.width
    broken = bytearray(wavelet.write_matrix(ids, np.array([5]), np.array([n])))
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(bytes(broken))


def test_file_ends(library, monkeypatch):
    """A file ends with the document that brings it to FILE_TOKENS, wherever parts and batches end."""
    monkeypatch.setattr(wavelet, "FILE_TOKENS", 40)
    monkeypatch.setattr(tokens, "PART", 70)
    rng = random.Random(2)
    texts = [None if i % 9 == 0 else "a b" * rng.randrange(12) + " x" * (300 * (i == 50)) for i in range(200)]
    spans = ((0, 33), (33, 1), (34, 0), (34, 166))
    batches = [pa.record_batch([pa.array(range(a, a + n), pa.int64()), pa.array(texts[a : a + n], pa.string())], ["doc_id", "text"]) for a, n in spans]
    files = [r for b in wavelet._write(iter(batches), ChunkEncoder(tokenizer_file()), 0, 7) for r in b.to_pylist()]
    want, held = [], []
    for i, x in enumerate(texts):
        held.append((i, library(x) + [0]))
        if sum(len(ids) for _, ids in held) >= 40 or i == 199:
            want.append(held)
            held = []
    assert [(r["shard"], r["file"], r["n_docs"], r["n_tokens"]) for r in files] == [(7, k, len(w), sum(len(ids) for _, ids in w)) for k, w in enumerate(want)]
    for r, w in zip(files, want):
        ids = np.array([t for _, one in w for t in one], np.uint32)
        assert r["content"] == wavelet.write_matrix(ids, np.array([i for i, _ in w]), np.array([len(one) for _, one in w]))


def test_wavelet_files(spark, library):
    rows = [(7 * i % 23, x, 1) for i, x in enumerate(ODD)] + [(None, "null id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = wavelet.read_files(wavelet.write_files(df, tokenizer_file())).collect()
    at = 0
    for doc_id, text, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        want = library(text) + [0]
        r = next(r for r in got if r.doc_id == doc_id)
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in wavelet.round_trip(df).collect()}
    assert digests == {(r.doc_id, r.start): (r.n_tokens, zlib.crc32(r.ids)) for r in got}
    assert wavelet.round_trip(df.limit(0)).count() == 0
