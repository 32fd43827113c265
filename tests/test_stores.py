"""Stored tables: versions with one winner each, buckets, JSON lines, running numbers, XML texts, nearest rows."""

import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.operators import retrieval as R
from lodestone.operators.numbering import running_numbers
from lodestone.plans import audit
from lodestone.sources import catalog_xml, stores


@pytest.fixture
def store(spark, tmp_path):
    return stores.SnapshotStore(spark, str(tmp_path / "store"))


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_versions(spark, store):
    one = store.write("t", spark.range(3))
    two = store.write("t", spark.range(5))
    assert store.version("t") == 2 and one.count() == 3 and two.count() == 5 == store.size("t") and store.read("t", 1).count() == 3
    with pytest.raises(stores.Conflict):
        store.write("t", spark.range(1), after=1)
    assert store.version("t") == 2 and store.size("t") == 5 and store.size("none") == 0
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_two_writers_lose_no_update(spark, store):
    store.write("t", spark.range(1))
    met = threading.Barrier(2)

    def add(value):
        tries = []

        def change(old):
            tries.append(1)
            if len(tries) == 1:
                met.wait(60)  # both begin from the same version
            return old.unionByName(spark.range(value, value + 1))

        store.update("t", change)
        counts.append(len(tries))

    counts = []
    threads = [threading.Thread(target=add, args=(v,)) for v in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert numbers(store.read("t")) == [0, 10, 20] and sorted(counts) == [1, 2] and store.version("t") == 3


def test_verdict_updates(spark, store):
    rows = [("a", "pending", "", None), ("b", "pending", "", "x")]
    store.write("candidates", spark.createDataFrame(rows, "id string, verdict string, explanation string, entrypoint string"))
    audit.update_verdict(store, "a", "verified", "why", entrypoint="main")
    audit.update_verdicts(store, spark.createDataFrame([("b", "needs_review", "so"), ("zz", "verified", "-")], "id string, verdict string, explanation string"))
    assert sorted(map(tuple, store.read("candidates").collect())) == [("a", "verified", "why", "main"), ("b", "needs_review", "so", "x")]
    with pytest.raises(KeyError):
        audit.update_verdict(store, "q", "verified")
    with pytest.raises(ValueError):
        audit.update_verdict(store, "a", "maybe")
    assert store.version("candidates") == 3


def files_by_bucket(store, name):
    folder = store._folder(name, store.version(name))
    return {b: {(f, os.stat(f"{folder}/{b}/{f}").st_mtime_ns) for f in os.listdir(f"{folder}/{b}") if f.endswith(".parquet")} for b in os.listdir(folder) if "=" in b}


def test_only_touched_buckets_are_written(spark, store):
    table = store.bucketed("index", "file", 8)
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "file string, n int")
    every = [f"f{i}" for i in range(40)]
    assert table.replace(keys(*every), rows(*((f, 0) for f in every), ("f1", 1))) == 8
    before = files_by_bucket(store, "index")
    time.sleep(0.05)
    assert table.replace(keys("f1", "new"), rows(("new", 5))) <= 2
    after = files_by_bucket(store, "index")
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and set(before) == set(after)
    got = sorted(map(tuple, store.read("index").collect()))
    assert got == sorted([(f, 0) for f in every if f != "f1"] + [("new", 5)])
    assert table.replace(keys(), rows()) == 0 and store.version("index") == 2
    assert table.replace(keys(*every, "new"), rows()) == 8 and store.size("index") == 0
    assert table.replace(keys("f3"), rows(("f3", 9))) == 1 and store.size("index") == 1


def test_unchanged_buckets_of_the_index_keep_their_files(spark, store):
    files = lambda edited: spark.createDataFrame([(f"d{i}.py", f"def f{i}():\n    return {i if i != edited else -1}\n") for i in range(30)], "path string, content string").withColumn("md5", F.md5("content"))
    assert audit.build_index(files(None), store, "python") == {"new": 30}
    before = files_by_bucket(store, "index")
    assert audit.build_index(files(7), store, "python") == {"unchanged": 29, "changed": 1}
    after = files_by_bucket(store, "index")
    assert sum(after[b] != before[b] for b in after) == 1 and store.size("index") == 30
    assert "-1" in store.read("index").where("file = 'd7.py'").first().code


def test_json_lines(spark, tmp_path):
    texts = ['{"id": "1", "file": "a", "matched_cwes": ["x", null], "more": 5}', '{"id": "2"}', '{"id": ', "", "[1]", '{"id": 3, "file": {"no": 1}}', '{"file": "z"}', "null"]
    lines = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    rows, lost = stores.from_json_lines(lines, stores.PACKAGE, "file")
    got = {r.n: r for r in rows.collect()}
    assert got[0].id == "1" and got[0].matched_cwes == ["x", None] and got[6].id is None and 1 not in got and 2 not in got
    assert sum(r.n for r in lost.collect()) + len(got) == len(texts) and {r.reason for r in lost.collect()} == {"broken", "incomplete"}
    held = spark.createDataFrame(rows.collect(), rows.schema)
    back, none = stores.from_json_lines(stores.to_json_lines(held, ["n"]), stores.PACKAGE, "file")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and none.count() == 0
    (tmp_path / "cand-1.json").write_text(json.dumps({"id": "1", "file": "a", "code": "x\ny"}, indent=2))
    (tmp_path / "cand-2.json").write_text("{broken")
    assert [(r.id, r.code) for r in stores.read_packages(spark, str(tmp_path)).collect()] == [("1", "x\ny")]
    assert [tuple(r) for r in stores.lost_packages(spark, str(tmp_path)).collect()] == [("broken", 1)]


def test_catalog_texts(spark, tmp_path):
    body = """<?xml version="1.0"?><Weakness_Catalog xmlns="http://cwe.mitre.org/cwe-7"><Weaknesses>
<Weakness ID="1" Name="A &amp; B" Status="Draft"><Description>if a &lt; b <i>and</i> more</Description>
 <Extended_Description>top<p> one &gt; </p><p>two</p></Extended_Description>
 <Common_Consequences><Consequence><Scope>S</Scope><Scope> </Scope></Consequence></Common_Consequences>
 <Demonstrative_Examples><Demonstrative_Example><Intro_Text>in <b>the</b> loop</Intro_Text><Example_Code Nature="Bad" Language="C">for (i = 0; i &lt; n; i++) {<br/>  x[i] = &quot;&#65;&amp;lt;&quot;; }</Example_Code></Demonstrative_Example></Demonstrative_Examples>
 <Potential_Mitigations><Mitigation><Phase>Design</Phase><Phase>Build</Phase><Description>a<p>b</p></Description></Mitigation></Potential_Mitigations></Weakness>
<Weakness ID="2" Name="n" Status="Draft"><Description/></Weakness></Weaknesses></Weakness_Catalog>"""
    (tmp_path / "c.xml").write_text(body)
    got = {r.id: r for r in catalog_xml.load_catalog(spark, str(tmp_path / "c.xml"), "all").collect()}
    w = got["1"]
    assert (w.name, w.description, w.extended_description) == ("A & B", "if a < b", "one >\ntwo")
    assert w.consequences[0].scopes == ["S", ""] and w.demonstrative_examples[0].intro == "in the loop"
    assert w.demonstrative_examples[0].code == 'for (i = 0; i < n; i++) {  x[i] = "A&lt;"; }'
    assert [(m.phase, m.description) for m in w.potential_mitigations] == [("Design", "ab")] and got["2"].description == ""
    path = str(tmp_path / "c.json")
    stores.write_catalog_json(catalog_xml.load_catalog(spark, str(tmp_path / "c.xml"), "all"), path)
    assert sorted(map(str, stores.read_catalog_json(spark, path).collect())) == sorted(map(str, got.values()))


def test_running_numbers(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), F.lit(None).cast("string").alias("s"), "id")
    got = running_numbers(df, [F.desc("k"), "id"], "n").collect()
    want = sorted(((-r.k, r.id) for r in got))
    assert [(-r.k, r.id) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 2001))
    assert running_numbers(df.limit(0), ["id"], "n").count() == 0
    plan = running_numbers(df, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    same = spark.createDataFrame([(1,)] * 50, "k int")
    assert sorted(r.n for r in running_numbers(same, ["k"], "n").collect()) == list(range(1, 51))


def test_languages_of(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"languages": {"rust": {"extensions": [".rs"]}}, "aliases": {}, "ext_to_lang": {".rs": "rust"}}))
    before, signals = dict(K.LANGUAGES), list(K.COMMON_SIGNALS)
    with stores.languages_of(str(tmp_path / "l.json")):
        assert set(K.LANGUAGES) == {"rust"} and K.COMMON_SIGNALS == []
    assert before == K.LANGUAGES and signals == K.COMMON_SIGNALS
    with pytest.raises(KeyError), stores.languages_of(str(tmp_path / "l.json")):
        raise KeyError
    assert before == K.LANGUAGES
    with pytest.warns(UserWarning, match="language tables"), stores.languages_of(str(tmp_path / "none.json")):
        assert before == K.LANGUAGES
    with pytest.warns(UserWarning, match="technology rules"):
        stores.load_rules(str(tmp_path / "none.json"))


def test_nearest_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(60)]
    rows = [(f"f{i % 3}", f"n{i:04d}", vectors[i % 60]) for i in range(3000)] + [("f", "null", None), ("f", "short", [1.0]), ("f", "hole", [1.0, None, 1.0, 1.0])]
    index = spark.createDataFrame(rows, "file string, name string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:9])] + [(99, None), (98, [2.0])], "intent_id int, query array<float>")
    got = R.cosine_top_k(index, asked, 40, 0.3).collect()
    for i, q in enumerate(vectors[:9]):
        score = lambda v: round(float(np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-9)), 12)  # noqa: B023, E731
        want = sorted(((-score(v), f, n) for f, n, v in rows[:3000]))[:40]
        mine = sorted(((r.rank, r.file, r.name) for r in got if r.intent_id == i))
        assert [x[1:] for x in mine] == [x[1:] for x in want if -x[0] >= 0.3]
    assert {(r.intent_id, r.name) for r in got if r.intent_id > 90} == {(98, "short")}
    plan = R.cosine_top_k(index, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2  # one step for each length of vector


def test_catalog_texts_without_a_parser(spark):
    """What is decoded without a parser is what XPath makes of it; only markup with tags and the like goes to the parser."""
    from pyspark.sql import functions as F

    from lodestone.sources import catalog_xml as C

    texts = ["", "a", " a\tb\nc ", "&lt;b&gt;", "&amp;lt;", "&amp;amp;", "&quot;&apos;", "a & b", "&&amp;", "&x;", "&#65;", "&#x41;b", "a\r\nb", "é一\U0001f600", "<i>x</i>y", "y<i>x</i>", "a > b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    element = C._element(F.col("t"))
    want = rows.select(F.xpath_string(element, F.lit("/x")), F.xpath_string(element, F.lit("/x/node()[1][self::text()]"))).collect()
    got = rows.select(C._text(F.col("t"), "/x"), C._text(F.col("t"), "/x/node()[1][self::text()]")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_catalog_details_read_the_elements_once(spark):
    from pyspark.sql import functions as F

    from lodestone.sources import catalog_xml as C

    rows = spark.range(3).select(F.lit('<Weakness ID="1" Name="n"></Weakness>').alias("xml"), F.col("id").alias("ord"))
    plan = C.catalog_details(C.parse_catalog(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
