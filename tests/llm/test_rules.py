import math
import random
import re
from collections import Counter

import pytest
import xxhash

from lodestone.llm import quality_rules as q


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def buckets(text, n):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = []
    for a, b in zip(h, h[1:]):
        one = xxhash.xxh64_intdigest((a & (2**64 - 1)).to_bytes(8, "little"), seed=42)
        pairs.append(signed(xxhash.xxh64_intdigest((b & (2**64 - 1)).to_bytes(8, "little"), seed=one)) % n)
    return [x % n for x in h] + pairs


ODD = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \n \nx", "<|> #*$%& é　é", "a\x0bb\x0cc\rd\x1ce",
    "same line\nsame line\n" * 60, " ".join(f"w{i}" for i in range(60)), "w " * 20000, " ".join(f"w{i % 997}" for i in range(30000)), "a b c d a b c d x y z x y z",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#"]) for _ in range(rng.randrange(200))) for _ in range(200)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean")


def test_base_counts(spark, texts):
    got = q.judge(frame(spark, texts), [0.0] * 16).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]
        assert r.ratio == 0 and r.kept == (not r.base_failed)


def test_ratios_against_plain_counts(spark, texts):
    docs, n = frame(spark, texts), 64
    trusted = spark.createDataFrame([(i,) for i in range(12, 60)] + [(13,), (None,), (10**6,)], "doc_id long")
    ratios = q.fit_ratios(docs, trusted, buckets=n)
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(buckets(t, n))
        if 12 <= i < 60:
            target.update(buckets(t, n))
    nr, nt = sum(raw.values()) + n, sum(target.values()) + n
    want = [(math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr)) * raw[b] / (raw[b] + 200) for b in range(n)]
    assert ratios == pytest.approx(want)
    for r in q.judge(docs, ratios).collect():
        b = buckets(texts[r.doc_id], n)
        assert r.ratio == pytest.approx(sum(want[x] for x in b) / len(b) if b else 0.0)
        assert r.kept == (not r.base_failed and r.ratio >= q.LEAST_RATIO)


def test_empty_tables(spark, texts):
    none = frame(spark, texts).limit(0)
    assert q.fit_ratios(none, none.select("doc_id"), buckets=8) == [0.0] * 8
    assert q.apply_rules(none, none.select("doc_id")).count() == 0


def test_plan_stays_in_the_jvm(spark, texts):
    plan = q.judge(frame(spark, texts), [0.0] * 16)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_buckets_grow_with_the_ngrams(spark):
    docs = frame(spark, [" ".join(f"w{i}" for i in range(k, k + 5000)) for k in range(0, 600_000, 5000)])
    n = 120 * (2 * 5000 - 1)
    assert q.bucket_count(docs) == q.PER_ROOT * math.isqrt(n) > q.BUCKETS
    assert len(q.fit_ratios(docs, docs.select("doc_id").limit(1))) == q.bucket_count(docs)
    assert q.bucket_count(docs.limit(1)) == q.bucket_count(docs.limit(0)) == q.BUCKETS


@pytest.mark.parametrize("held", [64, 8])
def test_tables_give_the_ratios_of_the_literal(spark, texts, monkeypatch, held):
    docs, trusted = frame(spark, texts), spark.createDataFrame([(i,) for i in range(12, 60)], "doc_id long")
    want = {r.doc_id: r for r in q.judge(docs, q.fit_ratios(docs, trusted, buckets=64)).collect()}
    monkeypatch.setattr(q, "LITERAL", 8)
    monkeypatch.setattr(q, "HELD", held)
    ratios = q.fit_ratios(docs, trusted, buckets=64)
    judged = q.judge(docs, ratios)
    assert isinstance(ratios, q.Ratios) and not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().toString())
    got = judged.collect()
    assert len(got) == len(texts) and set(judged.columns) == set(want[0].asDict())
    for r in got:
        assert r.ratio == pytest.approx(want[r.doc_id].ratio, abs=1e-9) and r.kept == want[r.doc_id].kept


def test_counts_do_not_grow_with_the_files(spark, texts):
    """Bucket counts are shuffled a row for FILL n-grams or for each core's task and bucket at most, not for each part of the table."""
    docs = frame(spark, [" ".join(f"w{i * k}" for i in range(400)) for k in range(1, 65)]).repartition(64).cache()
    trusted = spark.createDataFrame([(i,) for i in range(12, 60)], "doc_id long")
    assert docs.count() == 64 == docs.rdd.getNumPartitions()
    gateway, jvm = spark.sparkContext._gateway, spark._jvm

    def written():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    got = q.fit_ratios(docs, trusted, buckets=64)
    most = max(n for stage, n in written().items() if stage not in before)
    assert most <= max(spark.sparkContext.defaultParallelism * 64, 64 * 799 // q.FILL)
    assert got == pytest.approx(q.fit_ratios(docs.coalesce(1), trusted, buckets=64))
