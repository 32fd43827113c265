import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lines as L
from lodestone.operators import merging as M
from lodestone.plans import audit, report
from lodestone.sources import files as sources
from lodestone.sources import stores
from lodestone.sources.catalog_xml import load_catalog
from lodestone.streaming import watch

XML = """<?xml version="1.0"?>
<Weakness_Catalog xmlns="http://cwe.mitre.org/cwe-7"><Weaknesses>
<Weakness ID="007" Name="Old" Status="Draft"><Description>first</Description></Weakness>
<Weakness ID="1" Name="No languages" Status="Draft"><Description>Plain &amp; text</Description></Weakness>
<Weakness ID="2" Name="Python only" Status="Draft"><Description>d</Description><Applicable_Platforms><Language Class="Python" Prevalence="Often"/></Applicable_Platforms></Weakness>
<Weakness ID="3" Name="C only" Status="Draft"><Description>d</Description><Applicable_Platforms><Language Class="C"/></Applicable_Platforms></Weakness>
<Weakness ID="4" Name="C and any" Status="Draft"><Description>d</Description><Applicable_Platforms><Language Class="C"/><Language Class="Not Language-Specific"/></Applicable_Platforms></Weakness>
<Weakness ID="5" Name="Name attribute" Status="Draft"><Description>d</Description><Applicable_Platforms><Language Name="PHP"/></Applicable_Platforms></Weakness>
<Weakness ID="639" Name="Authorization bypass through user key" Status="Draft"><Description>load user record by id without check</Description>
 <Common_Consequences><Consequence><Scope>Access Control</Scope><Scope>Integrity</Scope><Impact>Bypass</Impact><Note>n</Note></Consequence></Common_Consequences>
 <Demonstrative_Examples><Demonstrative_Example><Intro_Text>intro</Intro_Text><Example_Code Nature="Bad" Language="Python">x = <b>load</b>(id)</Example_Code><Example_Code Nature="Good" Language="Python">ok()</Example_Code></Demonstrative_Example></Demonstrative_Examples>
 <Observed_Examples><Observed_Example><Reference>CVE-1</Reference><Description>seen</Description></Observed_Example></Observed_Examples>
 <Potential_Mitigations><Mitigation><Phase>Design</Phase><Description>check</Description></Mitigation><Mitigation><Phase>Design</Phase><Description> </Description></Mitigation></Potential_Mitigations></Weakness>
<Weakness ID="502" Name="Deserialization of untrusted data" Status="Draft"><Description>pickle</Description></Weakness>
<Weakness ID="007" Name="New" Status="Draft"><Description>last</Description></Weakness>
</Weaknesses></Weakness_Catalog>"""

SOURCE = '''import os

def load_user_record(user_id):
    """Load the record of a user by id, without permission."""
    row = objects.get(user_id)
    data = row.to_dict()
    data["owner"] = user_id
    return data


def show_user(request):
    user = load_user_record(request.user_id)
    if not user:
        return None
    text = render(user)
    log(text)
    return text


def run_command(text):
    value = eval(text)
    print(value)
    check = value + 1
    other = check * 2
    return other
'''


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    for path, text in {"src/api/users.py": SOURCE, "src/tests/test_users.py": SOURCE, "README.md": "hello", "src/bad name+x.py": "def f():\n    eval(x)\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/broken.py").write_bytes(b"def g():\n    return '\xff'\n")
    (tmp_path / "catalog.xml").write_text(XML)
    return tmp_path


def test_catalog(spark, project):
    path = str(project / "catalog.xml")
    got = {r.id: r for r in load_catalog(spark, path, "python").collect()}
    assert set(got) == {"007", "1", "2", "4", "5", "639", "502"}
    assert got["007"].name == "New" and got["1"].languages == ["Language-Independent"] == got["5"].languages and got["4"].languages == ["C", "Not Language-Specific"]
    w = got["639"]
    assert got["1"].description == "Plain & text" and [e.code for e in w.demonstrative_examples] == ["x = load(id)"] and w.demonstrative_examples[0].intro == "intro"
    assert w.consequences[0].scopes == ["Access Control", "Integrity"] and [m.description for m in w.potential_mitigations] == ["check"] and w.observed_examples[0].cve == "CVE-1"
    assert {r.id for r in load_catalog(spark, path, "rust").collect()} == {"007", "1", "4", "5", "639", "502"}
    assert load_catalog(spark, path, "all").count() == 8
    summary = json.loads(stores.write_catalog_json(load_catalog(spark, path, "all"), str(project / "catalog.json")))
    assert summary["count"] == 8


def test_files(spark, project):
    files = sources.scan_files(spark, str(project / "project"))
    paths = {r.path for r in files.collect()}
    assert paths == {"src/api/users.py", "src/tests/test_users.py", "README.md", "src/bad name+x.py", "src/broken.py"}
    assert {r.path for r in sources.index_files(files, [".py"]).collect()} == {"src/api/users.py", "src/bad name+x.py", "src/broken.py"}
    assert sources.dominant_language(files) == "python" and sources.dominant_language(files.limit(0)) == "cpp" and sources.dominant_language(files.limit(0), True) == "c/cpp"
    assert len(files.where("path = 'src/api/users.py'").first().md5) == 32


def test_incremental_index(spark, project, tmp_path):
    store, root = stores.SnapshotStore(spark, str(tmp_path / "ws")), project / "project"
    scan = lambda: sources.scan_files(spark, str(root))
    assert audit.index_size(store) == 0
    assert audit.build_index(scan(), store, "python") == {"new": 3}
    names = lambda: sorted((r.file, r.name) for r in store.read("index").collect())
    first = names()
    assert ("src/api/users.py", "load_user_record") in first and not any("tests" in f for f, _ in first)
    version = store.version("index")
    assert audit.build_index(scan(), store, "python") == {"unchanged": 3} and store.version("index") == version
    (root / "src/bad name+x.py").write_text("def renamed():\n    pass\n")
    (root / "src/broken.py").unlink()
    (root / "src/new.py").write_text("def fresh():\n    pass\n")
    assert audit.build_index(scan(), store, "python") == {"unchanged": 1, "changed": 1, "deleted": 1, "new": 1}
    whole = stores.SnapshotStore(spark, str(tmp_path / "whole"))
    audit.build_index(scan(), whole, "python")
    assert names() == sorted((r.file, r.name) for r in whole.read("index").collect())
    hits = audit.search(store.read("index"), spark.createDataFrame([("i", "load user record")], "intent_id string, text string"), 2)
    assert hits.orderBy("rank").first().name == "load_user_record"
    with pytest.raises(FileNotFoundError):
        store.read("nothing")


def test_pipeline(spark, project, tmp_path):
    cfg = audit.AuditConfig(str(project / "project"), str(project / "catalog.xml"), str(tmp_path / "ws"))
    intents = spark.createDataFrame([("task-cwe-639", ["load user record by user id", "show user"], "Check the owner.")], "id string, query_intents array<string>, vulnerability_prompt string")
    out = audit.run_pipeline(spark, cfg, intents)
    store = stores.SnapshotStore(spark, cfg.workspace)
    tasks = store.read("tasks")
    assert out["language"] == "python" and "502" not in {r.cwe_id for r in tasks.collect()}
    assert {r.id for r in audit.tasks_needing_intents(tasks).collect()} == {r.id for r in tasks.collect()} - {"task-cwe-639"}
    found = {r.function: r for r in store.read("candidates").collect()}
    assert "load_user_record" in found and "639" in found["load_user_record"].matched_cwes
    assert found["load_user_record"].recall_source in ("both", "vector") and found["load_user_record"].entrypoint == "show_user"
    assert "show_user" in found["load_user_record"].context and out["counts"]["pending"] == len(found)
    package = store.read("packages").where("function = 'load_user_record'").first()
    assert "Check the owner." in package.prompt and any("Authorization" in w for w in package.weaknesses)
    assert {(r.file, r.function) for r in out["gaps"].collect()} >= {("src/bad name+x.py", "f")}
    key = found["load_user_record"].id
    votes = spark.createDataFrame([(key, lens, True, True, False, "why", "path A", "None") for lens in "abc"], stores.VOTE.replace("confidence string, ", "").replace("attack_path string, has_missing boolean", "has_missing boolean").replace("reason string, has_path boolean", "has_path boolean").replace("missing string", "reason string, attack_path string, missing string"))
    assert out["sizes"]["classes"] == 8 and out["sizes"]["retained"] == tasks.count() and out["sizes"]["recalled"]["total"] >= len(found)
    where = stores.workspace(cfg.project, cfg.workspace)
    assert stores.read_packages(spark, where["candidates"]).count() == len(found) and open(where["report"]).read() == out["report"]
    again = audit.run_pipeline(spark, cfg, intents, spark.createDataFrame([], "candidate_id string, severity int"), votes)
    assert again["counts"]["verified"] == 1 and again["counts"]["pending"] == 0
    assert "## Verified\n\n1. ### `load_user_record`" in again["report"] and "Attack path: path A" in again["report"]


def test_packages_and_rules(spark, tmp_path):
    (tmp_path / "cand-1.json").write_text(json.dumps({"id": "1", "file": "a\\b.py", "function": "f"}))
    (tmp_path / "cand-2.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps({"id": "3", "file": "c", "function": "f"}))
    assert [(r.id, r.file) for r in stores.read_packages(spark, str(tmp_path)).collect()] == [("1", "a/b.py")]
    (tmp_path / "rules.json").write_text(json.dumps({"_note": "x", "net": {"patterns": ["socket"], "cwes": [601]}}))
    assert stores.load_rules(str(tmp_path / "rules.json")) == {"net": (["socket"], ["601"])}
    assert "memory" in stores.load_rules(str(tmp_path / "none.json"))
    df = spark.createDataFrame([("1", "a", "f")], "id string, file string, function string")
    stores.write_packages(df, str(tmp_path / "out"))
    assert [(r.id, r.file, r.function) for r in stores.read_packages(spark, str(tmp_path / "out")).collect()] == [("1", "a", "f")] and stores.workspace("/p")["plan"] == "/p/.audit_workspace/plan"


def test_report(spark):
    empty = report.markdown(None, 0)
    assert "No candidates" in empty
    c = spark.createDataFrame([("c1", "needs_review", "f", "a.py", ["79", "89"], "79", "", None, 1), ("c2", "verified", "g", "b.py", [], "MULTI", "e", "x", 2)], "id string, verdict string, function string, file string, matched_cwes array<string>, cwe_id string, entrypoint string, explanation string, ord int")
    votes = spark.createDataFrame([("c1", "l", "None", "no caller"), ("c2", "l", "p", "m")], "candidate_id string, lens string, attack_path string, missing string")
    text = report.markdown(c, 5, votes)
    assert "| Classes scanned | 2 |" in text and "CWE-79 / CWE-89" in text and "Missing evidence: no caller" in text and "Attack path: p" in text and "Missing evidence: m" not in text
    gaps = spark.createDataFrame([("a", "f", 3, "x|" + "y" * 90)], "file string, function string, line int, content string")
    assert report.gap_lines(gaps).first()["row"].endswith("...` |")
    assert M.scanned_classes(0, 0, 7) == 7 and M.scanned_classes(3, 2, 7) == 3


def test_watch(spark, tmp_path):
    store, inbox = stores.SnapshotStore(spark, str(tmp_path / "ws")), tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps(r) for r in [{"path": "a.py", "content": "def f():\n    pass", "seen_at": "2024-01-01T00:00:00"}, {"path": "b.py", "content": "def g():\n    pass", "seen_at": "2024-01-01T00:00:00"}]))
    watch.watch(spark, str(inbox), store, "python", str(tmp_path / "cp")).awaitTermination(120)
    (inbox / "2.json").write_text("\n".join(json.dumps(r) for r in [{"path": "a.py", "content": "def h():\n    pass", "seen_at": "2024-01-02T00:00:00"}, {"path": "b.py", "content": None, "seen_at": "2024-01-02T00:00:00"}]))
    watch.watch(spark, str(inbox), store, "python", str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.file, r.name) for r in store.read("index").collect()] == [("a.py", "h")]


def test_text_lines_are_kept(spark):
    rows = spark.createDataFrame([("f", "a\n\nb\n")], "file string, content string")
    assert [(r.line_no, r.line) for r in L.explode_lines(rows, ["file"]).orderBy("line_no").collect()] == [(1, "a"), (2, ""), (3, "b"), (4, "")]
    assert rows.select(F.size(F.split("content", "\n", -1))).first()[0] == 4


def test_resource_events_are_bounded_by_signal_and_order(spark, tmp_path, monkeypatch):
    """Many definitions and usages of one signal do not crowd out the others' first ones."""
    (tmp_path / "p").mkdir()
    body = "def execute(x):\n    a = user_id + 1\n    b = a * 2\n    c = b - 3\n    return c\n\n\n"
    for i in range(60):
        (tmp_path / "p" / f"f{i}.py").write_text(body)
    (tmp_path / "p" / "z.py").write_text(SOURCE)
    (tmp_path / "c.xml").write_text(XML)
    caught = []
    quota = audit.R.resource_quota
    monkeypatch.setattr(audit.R, "resource_quota", lambda events, known: caught.append(events) or quota(events, known))
    audit.run_pipeline(spark, audit.AuditConfig(str(tmp_path / "p"), str(tmp_path / "c.xml"), str(tmp_path / "w")))
    found = caught[0].groupBy("task_id", "signal_ord", "phase").agg(F.count("*").alias("n"), F.max("ord").alias("last")).collect()
    most = {phase: max(r.n for r in found if r.phase == phase) for phase in (0, 1)}
    assert most == {0: audit.K.LEXICAL_LIMIT, 1: audit.K.RESOURCE_LIMIT}
    assert all(r.n == r.last for r in found)


def test_coverage_scans_one_language(spark):
    """Only files of the dominant language are scanned, with that language's pattern."""
    rows = [("a.py", "def f():\n    eval(x)"), ("b.py", "def g():\n    pass"), ("c.c", "int h() {\n  eval(x);\n}")]
    files = spark.createDataFrame(rows, "path string, content string")
    gaps = audit.coverage(files, spark.createDataFrame([], "file string, function string"))
    assert [(r.file, r.function, r.line) for r in gaps.collect()] == [("a.py", "f", 2)]
    assert report.gap_table(gaps).count("| a.py |") == 1


def test_technology_of_all_languages(spark, project):
    """A tag found in a file of another language keeps its classes."""
    files = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "y = 2"), ("lib/c.java", "ObjectInputStream in;")], "path string, content string")
    tasks, language = audit.init_plan(load_catalog(spark, str(project / "catalog.xml"), "all"), files)
    assert language == "python" and "502" in {r.cwe_id for r in tasks.collect()}


def test_callers_from_text(spark):
    """A function that nobody calls has the functions that name it."""
    text = "def a():\n    register(b)\n\ndef b():\n    pass\n\ndef c():\n    a()\n"
    lines = L.explode_lines(spark.createDataFrame([("x.py", text)], "file string, content string"), ["file"])
    symbols = L.symbols_of(lines)
    got = audit.callers_of(spark.createDataFrame([("a",), ("b",)], "dst string"), audit.call_edges(lines, symbols), lines).collect()
    assert sorted((r.dst, r.src, r.is_fallback) for r in got) == [("a", "c", False), ("b", "a", True)]


def test_whole_type_definitions(spark):
    text = "class Box:\n    side = 1\n    top = 2\nstruct point { int x; }\n"
    lines = L.explode_lines(spark.createDataFrame([("x.py", text)], "file string, content string"), ["file"])
    c = spark.createDataFrame([("c1", "Box point Other")], "id string, code string")
    assert audit.definitions(c, lines, "python").first().struct_definitions == "// Definition for class Box\nclass Box:\n    side = 1\n    top = 2"


def test_language_file(spark, tmp_path):
    from lodestone.functions import constants as K

    tables = (K.LANGUAGES, K.MARKDOWN_TAGS, K.LANGUAGE_ALIASES, K.EXTENSION_LANGUAGE)
    saved, signals = [dict(t) for t in tables], list(K.COMMON_SIGNALS)
    try:
        stores.load_languages(str(tmp_path / "none.json"))
        assert saved == [dict(t) for t in tables]
        (tmp_path / "l.json").write_text(json.dumps({"languages": {"rust": {"extensions": [".rs"], "type_kinds": ["trait"]}}, "aliases": {"rs": "rust"}, "ext_to_lang": {".rs": "rust"}, "_common_resource_signals": ["get"]}))
        stores.load_languages(str(tmp_path / "l.json"))
        files = spark.createDataFrame([("a.rs", "x"), ("b.py", "y")], "path string, content string")
        assert sources.dominant_language(files) == "rust" and K.MARKDOWN_TAGS == {"rust": "rust"} and K.COMMON_SIGNALS == ["get"]
    finally:
        for table, old in zip(tables, saved):
            table.clear()
            table.update(old)
        K.COMMON_SIGNALS[:] = signals


def test_mentions_within_the_function_itself(spark):
    """A recursive mention counts for the header above, one without any for the module."""
    text = "def outer(x):\n    pass\ndef f(x):\n    y = [f]\ndef f(z):\n    y = (f)\n"
    lines = L.explode_lines(spark.createDataFrame([("x.py", text), ("y.py", "def f(x):\n    y = [f]\n"), ("z.py", "def fu(a):\n    go(fun)\ndef fun(a):\n    pass\n")], "file string, content string"), ["file"])
    got = audit.fallback_edges(lines, spark.createDataFrame([("f",), ("fun",)], "dst string")).collect()
    assert sorted((r.dst, r.src, r.file, r.line) for r in got) == [("f", "[module-level] y.py:2", "y.py", 2), ("f", "outer", "x.py", 4), ("fun", "fu", "z.py", 2)]


def test_generated_files_have_no_language(spark):
    files = spark.createDataFrame([("a.min.js",), ("b.min.js",), ("c.py",)], "path string")
    assert sources.dominant_language(files) == "python"


def test_context_text(spark):
    text = "def a():\n    b()\n    c()\n\ndef b():\n    c()\n\ndef c():\n    pass\n"
    lines = L.explode_lines(spark.createDataFrame([("x.py", text)], "file string, content string"), ["file"])
    symbols = L.symbols_of(lines)
    names = spark.createDataFrame([("a",), ("c",)], "function string")
    got = {r.function: r for r in audit.contexts(names, audit.call_edges(lines, symbols), L.symbol_sources(symbols, lines), lines).collect()}
    up, down = (audit.K.CONTEXT_CALLERS.format("c"), audit.K.CONTEXT_CALLEES.format("c"))
    assert got["c"].context == f"{audit.K.CONTEXT_TITLE}\n{up}\n- a (x.py):\n```\ndef a():\n    b()\n    c()\n```\n- b (x.py):\n```\ndef b():\n    c()\n```\n\n{down}\n  (none found)"
    assert got["c"].first_caller == "a" and got["a"].first_caller is None
    assert audit.K.CONTEXT_NO_CALLERS in got["a"].context and got["a"].context.endswith("\n  b (x.py), c (x.py)")


def test_wanted_types_are_joined_first(spark):
    lines = spark.createDataFrame([("x.py", 1, "class Box:")], "file string, line_no long, line string")
    plan = audit.type_definitions(lines, spark.createDataFrame([("Box",)], "type string"))._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window")
    assert plan.index("LeftSemi", window) > window


def test_lexical_lookup(spark):
    from lodestone.operators import lexical as X

    names = ["findById", "find_all", "byte_find", "FINDBYID", "user_find_by_id", "other"]
    symbols = spark.createDataFrame([(f"f{i}", n, i) for i, n in enumerate(names)], "file string, name string, line int")
    asked = spark.createDataFrame([(1, "findById"), (2, "nothing here"), (3, ""), (4, None)], "query_id int, text string")
    got = X.lookup(symbols, asked).orderBy("rank").collect()
    assert {r.query_id for r in got} == {1} and [r.rank for r in got] == list(range(1, len(got) + 1))
    assert got[0].name == "findById" and got[1].name == "user_find_by_id" and {r.name for r in got[2:]} == {"find_all", "byte_find"}
    assert [r.name for r in X.lookup(symbols, asked, 1).collect()] == ["findById"] and X.lookup(symbols.limit(0), asked).count() == 0
    old = X.QUERY_BLOCK
    try:
        X.QUERY_BLOCK = 2
        assert X.lookup(symbols, asked).count() == len(got)
    finally:
        X.QUERY_BLOCK = old


def _shuffled(spark, run) -> int:
    """Rows that ``run`` writes to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    none = sc._gateway.new_array(jvm.double, 0)

    def stages():
        return {s.stageId(): s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList()))}

    before = set(stages())
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for i, n in stages().items() if i not in before)


def test_lexical_pairs_grow_with_names_not_rows(spark):
    from lodestone.operators import lexical as X

    names = ["red_ring", "redRing", "blue_ring", "ring"]
    symbols = spark.range(3000).selectExpr("id AS file", f"element_at(array({', '.join(map(repr, names))}), int(id % 4) + 1) AS name", "1 AS line")
    intents = spark.range(400).selectExpr("id AS intent_id", "if(id % 2 = 0, 'red ring', 'redRing') AS text")
    asked, got = intents.withColumnRenamed("intent_id", "query_id"), []
    assert _shuffled(spark, lambda: got.append(X.lookup(symbols, asked).collect())) < 5_000
    assert _shuffled(spark, lambda: got.append(audit.lexical(symbols, intents).collect())) < 5_000
    for rows, key, first in zip(got, ("query_id", "intent_id"), ([0, 1, 4, 5, 8], [0, 1, 4, 5, 8])):
        assert len(rows) == 400 * 15
        for q in (0, 398):
            assert [r.file for r in sorted((r for r in rows if r[key] == q), key=lambda r: r.rank)][:5] == first
    assert [r.file for r in sorted((r for r in got[0] if r.query_id == 1), key=lambda r: r.rank)] == list(range(1, 60, 4))


def test_lexical_against_every_pair(spark):
    """Symbols listed twice, queries of several texts and ties between names count as in the plain pairing."""
    from collections import Counter

    names = ["red_ring", "RedRing", "blue_ring_ring", "ringBlue", "old_plate", "plate", "x"]
    listed = [(f"f{i % 23:02d}", names[i * 5 % 7], i % 3) for i in range(60)]
    listed += listed[::6]
    texts = [(i % 9, ["red ring", "blue plate ring", "ringBlue", "Old Plate", "none"][i * 3 % 5]) for i in range(14)]
    words = lambda t: {w for w in __import__("re").split("[^a-z0-9]+", __import__("re").sub("([a-z0-9])([A-Z])", r"\1 \2", t).lower()) if len(w) > 2}
    want = []
    for q in sorted({q for q, _ in texts}):
        asked, scores = Counter(w for k, t in texts if k == q for w in words(t)), {}
        for s in listed:
            scores[s] = scores.get(s, 0) + sum(asked[w] for w in words(s[1]))
        best = sorted((-n, *s) for s, n in scores.items() if n)[:15]
        want += [(q, f, n, line, -c, i + 1) for i, (c, f, n, line) in enumerate(best)]
    symbols = spark.createDataFrame(listed, "file string, name string, line int")
    got = audit.lexical(symbols, spark.createDataFrame(texts, "intent_id int, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
