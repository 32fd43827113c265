import hashlib
import random

import numpy as np
import tiktoken

from lodestone.llm import bpe

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "it's  we'll\tgo", "x y  z", "<|endoftext|> a<|endoftext|>", "é ñ 你好 12 345",
    "a" * 3000, "é" * 2500, "xyzabc" * 2000, "ab" * 60, "ß" * 97, " ".join("w%d" % i for i in range(3000)), "a\x1c b \x1c c", "tab\t tab", "  x  y", "end\n", "\x00 \x00", "‮ 🙂🙂 🙂", "aaaa bbbb", "　x 　 y", " " * 400,
]


def library():
    return tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks_file(), special_tokens={})


def test_heap_fold():
    ranks, enc, rng = bpe.ranks_file(), library(), random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("abcthe inéß你") for _ in range(rng.randrange(1, 60))).replace(" ", "")
        if word:
            assert bpe.fold_bytes(word.encode(), ranks) == enc._encode_single_piece(word)


def test_round_trip(spark, monkeypatch):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" \n\tabthe!'s1é　") for _ in range(rng.randrange(80))) for _ in range(200)]
    enc = library()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, "  ", "x", 1), (None, "n", "x", 1)], "doc_id long, text string, ids string, words int").coalesce(2)
    got = bpe.round_trip(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "n" if r.doc_id is None else texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids), repr(t)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_forgetting_and_many_rows(spark):
    enc = library()
    texts = [f"word{i} shared {'x' * (i % 5)}y tail{i % 7}" for i in range(500)]
    source = bpe.__dict__
    old = source["REMEMBERED"], source["WORDS_A_ROW"]
    batches = [b for b in __import__("pyarrow").table({"doc_id": list(range(500)), "text": texts}).to_batches(max_chunksize=50)]
    try:
        source["REMEMBERED"], source["WORDS_A_ROW"] = 60, 7
        rows = [r for b in bpe._gatherer(bpe.pattern())(iter(batches)) for r in b.to_pylist()]
    finally:
        source["REMEMBERED"], source["WORDS_A_ROW"] = old
    assert sum(bool(r["forget"]) for r in rows) >= 5
    pa = __import__("pyarrow")
    ranks = bpe.ranks_file()
    for r in rows:
        r["ids"] = None if r["words"] is None else [bpe.fold_bytes(w.encode("latin-1"), ranks) for w in r["words"]]
    fields = [*bpe._FIELDS, pa.field("ids", pa.list_(pa.list_(pa.int32())))]
    whole = pa.Table.from_pylist(rows, pa.schema(fields)).combine_chunks().to_batches(max_chunksize=13)
    out = [r for b in bpe._assembler(iter(whole)) for r in b.to_pylist()]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in out] == [enc.encode_ordinary(t) for t in texts]


def test_few_common_words(spark, monkeypatch):
    """With and without words folded for the whole table the ids and the decoded bytes are the same."""
    texts = [f"shared{i % 3} other {i} Shared{i % 5}, x" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks, enc = bpe.ranks_file(), library()
    for common in (0, 3, 1000):
        monkeypatch.setattr(bpe, "COMMON", common)
        out = bpe.decode(bpe.encode(df, ranks, bpe.pattern()), ranks).collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
        assert {r.doc_id: bytes(r.decoded).decode() for r in out} == dict(enumerate(texts))


def test_displaced_tables():
    rng = np.random.default_rng(3)
    cells = {(int(a), int(b)): int(v) for a, b, v in rng.integers(0, 300, (4000, 3))}
    left, right, rank = np.array([(*k, v) for k, v in cells.items()]).T
    shift, owner, ranks = bpe.displace(left, right, rank, 300)
    for a in range(300):
        for b in range(300):
            at = shift[a] + b
            got = ranks[at] if 0 <= at < len(owner) and owner[at] == a else None
            assert got == cells.get((a, b))


def test_steps_hand_on_bounded_batches(monkeypatch):
    """However many rows a batch has, texts are taken and results handed on in small parts."""
    pa = __import__("pyarrow")
    monkeypatch.setattr(bpe, "SLICE", 4000, raising=False)
    fields = [*bpe._FIELDS, pa.field("ids", pa.list_(pa.list_(pa.int32())))]
    rows = [{"words": ["ab"], "forget": False, "forget_words": False, "chunks": np.array([0], "<i4").tobytes(), "lengths": np.array([1], "<i4").tobytes(), "ids": [[7]]}]
    rows += [{"doc_id": i, "refs": np.zeros(500, "<i4").tobytes()} for i in range(100)]
    batch = pa.Table.from_pylist(rows, pa.schema(fields)).combine_chunks().to_batches()
    out = list(bpe._assembler(iter(batch)))
    assert max(b.num_rows for b in out) <= 3
    assert [(r["doc_id"], r["ids"]) for b in out for r in b.to_pylist()] == [(i, np.full(500, 7, "<u4").tobytes()) for i in range(100)]
