import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import near_dedup
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import jaccard_counts, shingle_set


def words(rng, n):
    return [f"{rng.choice('abcdefghij')}{rng.randrange(4000)}" for _ in range(n)]


def copies(seed=1):
    rng, out = random.Random(seed), [None, "", "  \n", "One", "one", "ONE two", "one two", "a b c d e", "A B C D E", "a b c d e f"]
    for size in (2, 3, 5, 40, 400):
        base = words(rng, 120)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(9))
            out.append(" ".join(w))
    shared = " ".join(words(rng, 40))
    out += [f"{shared} {' '.join(words(rng, 60))}" for _ in range(120)]
    return out + out[10:20] + [" ".join(words(rng, 20000))] * 2


def plain(texts, per_cent):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a) and len(sets[j]):
                both, union = jaccard_counts(a, sets[j])
                if 100 * both >= per_cent * union:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("per_cent", [80, 85])
def test_against_all_pairs(spark, per_cent):
    texts = copies()
    df = spark.createDataFrame([(i, t, "x", b"k") for i, t in enumerate(texts)], "doc_id long, text string, component_id string, set_key binary")
    want, sizes = plain(texts, per_cent)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, per_cent).collect()}
    assert len(got) == len(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (2, 2, True), (2, 2, True), (4, 2, False), (9, 9, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in near_dedup.representatives(df).collect()) == [-1, -1, 2, 2, 9]


def test_crowded_regions_go_deeper():
    n = 400
    labels = np.zeros((n, near_dedup.DEPTH), np.uint16)
    labels[:, 5] = np.repeat(np.arange(40), 10)
    found = list(near_dedup.regions_of(np.zeros(n, np.int32), labels, limit=50))
    assert sorted((a, b) for a, b, _ in found) == [(i, i + 10) for i in range(0, n, 10)] and {d for *_, d in found} == {6}
    same = list(near_dedup.regions_of(np.zeros(n, np.int32), np.zeros((n, near_dedup.DEPTH), np.uint16), limit=50))
    assert all(b - a <= 50 for a, b, _ in same) and {i for a, b, _ in same for i in range(a, b)} == set(range(n))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 300)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(120)] + [(500, i) for i in range(501, 600)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {v: find(v) for v in root}


def test_star_of_copies(spark):
    """Each copy is like the master alone, so sorted neighbours in crowded regions do not connect them."""
    rng = random.Random(5)
    base, n = words(rng, 300), 3000
    texts = [" ".join(base)]
    for i in range(n):
        w = list(base)
        for k in range(5):
            w[rng.randrange(k * 60, k * 60 + 55)] = f"new{i}x{k}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    alike = [100 * b >= 80 * u for b, u in (jaccard_counts(sets[0], x) for x in sets[1:])]
    assert all(alike) and 100 * jaccard_counts(sets[5], sets[9])[0] < 80 * jaccard_counts(sets[5], sets[9])[1]
    df = spark.createDataFrame([(n - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 80)
    assert [(r.component_id, r["count"]) for r in got.groupBy("component_id").count().collect()] == [(0, n + 1)]
    assert [r.doc_id for r in got.where("kept").collect()] == [0]


@pytest.mark.parametrize("per_cent", [80, 85])
def test_estimates_lose_no_pair_at_the_threshold(per_cent):
    pairs = near_dedup._meet(near_dedup.least_estimate(per_cent), per_cent / 100)
    for off, found in ((4.9, 1), (5.2, 0)):
        share = per_cent / 100 - off * (per_cent / 100 * (1 - per_cent / 100) / near_dedup.POSITIONS) ** 0.5
        sig = np.zeros((2, near_dedup.POSITIONS), ">u2")
        sig[1, int(np.ceil(share * near_dedup.POSITIONS)) if found else int(share * near_dedup.POSITIONS) :] = 1
        batch = pa.RecordBatch.from_arrays(
            [pa.array([b"r"] * 2), pa.array([1, 2]), pa.array([False] * 2), pa.array([x.tobytes() for x in sig])], names=["region", "node", "deep", "sig"]
        )
        assert sum(b.num_rows for b in pairs(iter([batch]))) == found


def test_leaders():
    """One pair a row; near rows that no leader joins are open."""
    sig = np.zeros((4, 10), int)
    sig[1, :2], sig[2, 4:6], sig[3, 2:] = 1, 2, 3  # 1 and 2 are near 0 alone, 3 nobody
    assert near_dedup.leaders(sig, 0.7, 0.8) == ([(1, 0), (2, 0)], [])
    sig[3] = sig[1]
    pairs, open_ = near_dedup.leaders(sig, 0.7, 0.9)
    assert pairs == [(1, 0), (2, 0), (3, 1)] and open_ == [0, 3]


def test_one_id_with_several_texts(spark):
    """Rows that share an id are linked by their own texts; no link is lost, in either order."""
    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    for first, second in ((a, b), (b, a)):
        rows = [(2, first), (2, second), (5, b + ["more"]), (7, a + ["more"]), (9, c)]
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        got = near_dedup.near_duplicates(df, 85).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (2, 2), (5, 2), (7, 2), (9, 9)]


def test_pairs_grow_with_the_rows(spark):
    """A group of near copies gives pairs with leaders, not all pairs."""
    rng = random.Random(9)
    base, n = words(rng, 120), 3000
    texts = []
    for _ in range(n):
        w = list(base)
        w[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, persist = {}, near_dedup.persist_table

    def count(table, name):
        written[name] = persist(table, name)
        return written[name]

    near_dedup.persist_table = count
    try:
        got = near_dedup.near_duplicates(df, 80)
    finally:
        near_dedup.persist_table = persist
    assert got.where("component_id = 0").count() == n and got.where("kept").count() == 1
    assert written["pairs"].count() <= near_dedup.TREES * n


def test_shingles_by_hand():
    """Counts by a plain rule, apart from the operator's own shingle function."""
    import re

    for text in copies()[:60]:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        plain_set = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(shingle_set(text)) == len(plain_set)


def test_representatives_by_row(spark):
    """An id at two texts is two documents; one of each group stays."""
    w, z, v = "a b c d e f g h", "m n o p q r s t", "1 2 3 4 5 6 7 8"
    rows = [(1, w, "x"), (2, w, "x"), (2, z, "x"), (3, v, "x"), (3, v + " 9", "x"), (3, "", "x"), (3, None, "x"), (4, v, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    got = [(r.doc_id, r.text) for r in near_dedup.representatives(df, 80).collect()]
    assert len(got) == 5 and {(1, w), (2, z), (3, ""), (3, None)} < set(got) and len([t for i, t in got if t in (v, v + " 9")]) == 1
    assert near_dedup.representatives(df, 80).columns == df.columns


def test_unconnected_rows_of_a_crowd_are_not_tested(spark, monkeypatch):
    """Rows that share half of their text and no more form a crowd; what is exchanged grows with their number."""
    tested, kept = [], near_dedup.persist_table

    def spy(df, name):
        out = kept(df, name)
        if name in ("crowd-tested", "crowd-sets", "crowd-shingles"):
            tested.append((name, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "persist_table", spy)
    rng = random.Random(8)
    shared, counts = words(rng, 60), []
    for n in (1250, 5000):
        tested.clear()
        texts = [" ".join(shared + [f"{i}x{k}" for k in range(60)]) for i in range(n)] + [" ".join([*shared, *(f"7x{k}" for k in range(60)), "end"])]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = near_dedup.near_duplicates(df, 80)
        assert {r.doc_id for r in got.where("not kept").collect()} == {n}
        counts.append(dict(tested))
    for found in counts:
        assert found["crowd-sets"] >= 500 and found["crowd-tested"] <= 2 and found["crowd-shingles"] <= 200
    assert counts[1]["crowd-sets"] > 2 * counts[0]["crowd-sets"]
