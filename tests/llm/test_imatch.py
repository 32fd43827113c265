import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash

from lodestone.llm import imatch


def corpus(n=300):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([30, 200, 1500]))) for _ in range(n)]
    return texts + [texts[3], None, "", " ", "a", "é" * 7, "X y" * 50000, texts[5].upper()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string")


def check(got, rows):
    order = sorted(((i if i is not None else -(2**63), t or "") for i, t in rows), key=lambda r: (-r[0], r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        e = imatch.edited(t, order[(k + 1) % len(order)][1])
        want.append((i if i > -(2**63) else None, len(t), hashlib.sha256(e.encode()).hexdigest()))
    key = lambda x: (x[0] is not None, x)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)


def test_next_documents_and_likeness(spark):
    texts = corpus()
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)]
    got = imatch.fingerprint_documents(frame(spark, rows)).collect()
    check(got, rows)
    by = {(r.doc_id + 40) // 3: r for r in got}
    assert by[3].fingerprint == by[300].fingerprint and by[5].fingerprint == by[307].fingerprint
    assert by[301].fingerprint == by[302].fingerprint == by[303].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [by[i] for i in range(299)]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.08 > np.mean([r.near_next for r in long])
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_ties_nulls_and_small_tables(spark):
    rows = [(1, "b b"), (1, "a"), (1, "b b"), (None, "n"), (9, None), (9, "z")]
    check(imatch.fingerprint_documents(frame(spark, rows)).collect(), rows)
    for few in (rows[:1], rows[3:4], []):
        check(imatch.fingerprint_documents(frame(spark, few)).collect(), few)


def test_lexicon_is_the_idf_band(spark):
    rows = [(i, f"all {'half' if i % 2 else ''} only{i}") for i in range(100)]
    got = imatch.fit_lexicon(frame(spark, rows), low=0.02, high=0.6)
    assert got.tolist() == [imatch._hashes[b"half"]]


ALL = 2**64 - 1


def plain_mix(h):
    h = (h ^ h >> 31) * 0x7FB5D329728EA185 & ALL
    h = (h ^ h >> 27) * 0x81DADEF4BC2DD44D & ALL
    return h ^ h >> 33


def plain_fingerprint(text, lexicon):
    """First level, hash of all terms, and a number for each level and subset, by whole numbers alone."""
    hashes = {xxhash.xxh64_intdigest(t, seed=42) for t in text.encode().lower().split()}
    hashes = hashes & lexicon or hashes
    first = max(0, round(math.log2(max(1, len(hashes)))) - 1)
    out = [first, plain_mix(sum(hashes) & ALL) >> 48 if hashes else 0]
    for level in range(first, first + imatch.LEVELS):
        for subset in range(1, imatch.SUBSETS + 1):
            seed = plain_mix(subset * 0x9E3779B97F4A7C15 & ALL)
            held = [o for o in (plain_mix(h ^ seed) for h in hashes) if o <= ALL >> level]
            total = sum(map(plain_mix, held)) & ALL
            out.append(plain_mix(total) >> 48 | 1 if total else 0)
    return "".join(f"{x:04x}" for x in out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([int(f[i : i + 4], 16) for i in range(0, len(f), 4)] for f in (a, b))
    best = None
    for level in range(max(x[0], y[0]), min(x[0], y[0]) + imatch.LEVELS):
        u, v = (f[2 + (level - f[0]) * imatch.SUBSETS :][: imatch.SUBSETS] for f in (x, y))
        off = abs(sum(1 for p, q in zip(u, v) if p or q) - 0.6 * imatch.SUBSETS)
        held = sum(1 for p in u if p) + sum(1 for q in v if q)
        same = sum(1 for p, q in zip(u, v) if p == q and p)
        if best is None or off < best[0]:
            best = off, 2 * same / held if held else 0.0
    return best[1] if best else 0.0


def test_fingerprints_and_likeness_by_a_plain_version(spark):
    rows = list(enumerate(corpus(150)))
    texts = {i: t or "" for i, t in rows}
    counts = Counter(w for t in texts.values() for w in set(t.encode().lower().split()))
    n = len(texts)
    band = {xxhash.xxh64_intdigest(w, seed=42) for w, c in counts.items() if max(1, imatch.LOW * n) <= c <= imatch.HIGH * n}
    got = imatch.fingerprint_documents(frame(spark, rows)).collect()
    assert len(got) == n
    for r in got:
        following = texts[r.doc_id - 1 if r.doc_id else n - 1]
        own, other = plain_fingerprint(texts[r.doc_id], band), plain_fingerprint(following, band)
        changed = plain_fingerprint(imatch.edited(texts[r.doc_id], following), band)
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert abs(r.near_edited - plain_likeness(own, changed)) < 1e-12 and abs(r.near_next - plain_likeness(own, other)) < 1e-12


def test_the_plan_does_not_grow_with_the_parts(spark):
    docs = spark.range(5000).selectExpr("id * 3 as doc_id", "concat('w', id % 97, ' v', id) as text")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    plans = []
    try:
        for parts in (4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = imatch.with_following(docs)
            plans.append(len(rows._jdf.queryExecution().toString()))
            assert rows.count() == 5000 + len({r.part for r in rows.select("part").distinct().collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert abs(plans[1] - plans[0]) < 200
