import hashlib
import random
import re
import zlib

import pytest

from lodestone.llm import runs


def plain_runs(w, least_length=6, least=4):
    found, n = set(), len(w)
    for q in range(1, n // least + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if j > i and len(stretch) >= max(least_length, least * q):
                if all(any(x != y for x, y in zip(stretch, stretch[p:])) for p in range(1, q)):
                    found.add((i, len(stretch), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    letters, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 70)
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
    return w


def test_against_all_periods():
    rng, seen = random.Random(12), 0
    for _ in range(6000):
        w, least = some_words(rng), rng.choice([3, 4, 5])
        want = plain_runs(w, least=least)
        seen += len(want)
        assert runs.runs_of(w, least_exponent=least) == want, (w, least)
    assert seen > 4000
    with pytest.raises(ValueError):
        runs.runs_of([1, 1], least_exponent=2)


class Letter:
    """Can be compared, nothing else; comparisons are counted."""

    made, __hash__ = 0, None

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Letter.made += 1
        return self.v == other.v

    def __lt__(self, other):
        Letter.made += 1
        return self.v < other.v

    def __gt__(self, other):
        Letter.made += 1
        return self.v > other.v


def test_comparisons_are_linear():
    a, b, nested = "a", "ab", "a"
    while len(b) < 20000:
        a, b = b, b + a
    for k in range(30):
        nested = nested * 4 + "bcd"[k % 3]
        if len(nested) > 20000:
            break
    rng = random.Random(3)
    for text in ("a" * 20000, b, nested, "aaaaaab" * 3000, "".join(rng.choice("ab") for _ in range(20000)), "".join(map(chr, range(40, 20040)))):
        for descending in (False, True):
            Letter.made = 0
            runs.lyndon_stretches([Letter(c) for c in text], descending, 2)
            assert Letter.made <= 4 * len(text)


def words_of(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def plain_row(doc_id, text):
    w = words_of(doc_id, text)
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def test_query_against_a_plain_version(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a", "a " * 8, "é é é é é é é b b b b b b", "a\xa0a a\xa0a  a " * 5, "x y " * 40 + "z " * 9, "\x1ca \x1ca \x1ca \x1ca \x1ca \x1ca"]
    texts += [" ".join(f"w{x}" for x in some_words(rng)) for _ in range(300)] + ["\n".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1, "s", "n") for i, t in enumerate(texts)], "doc_id long, text string, runs int, start string, collapsed string")
    got = {r[0]: tuple(r[1:]) for r in runs.run_digests(runs.planted(df)).collect()}
    assert len(got) == len(texts) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in got) > 20
    for i, t in enumerate(texts):
        assert got[i] == plain_row(i, t), (i, t)


def test_odd_rows(spark):
    shape = "doc_id long, text string"
    assert runs.run_digests(runs.planted(spark.createDataFrame([], shape))).count() == 0
    df = spark.createDataFrame([(None, "b b b b b b b c"), (5, "q " * 6), (5, "q " * 6)], shape)
    rows = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in runs.find_runs(runs.planted(df)).collect()}
    assert rows == {(None, "b c"): [(0, 7, 1)], (5, "q"): [(0, 6, 1)]}
    assert runs.find_runs(df).count() == 3
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 200_000)], shape)
    r = runs.find_runs(long).first()
    assert [tuple(x) for x in r.runs] == [(0, 600_000, 3)] and r.collapsed == "lorem ipsum dolor"
