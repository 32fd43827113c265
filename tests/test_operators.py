import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import scalars as S
from lodestone.operators import lines as L
from lodestone.operators import merging as M
from lodestone.operators import retrieval as R


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, black, hint, generated",
    [("src/api/user.py", False, "high", False), ("src/Tests/user.py", True, "low", False), ("pkg/util.py", False, "medium", False), ("lib\\mock\\a.py", True, "low", False),
     ("dist/app.min.js", True, "medium", True), ("migrations/001.py", True, "medium", False), ("contest/a.py", False, "medium", False)],
)
def test_paths(spark, path, black, hint, generated):
    p = F.col("p")
    row = spark.createDataFrame([(path,)], "p string").select(S.blacklisted(p), S.reachability(p), S.generated_file(p)).first()
    assert tuple(row) == (black, hint, generated)


def test_languages_and_labels(spark):
    x = F.col("x")
    assert one(spark, S.normalise_language(x), x="TypeScript") == "js" and one(spark, S.normalise_language(F.lit(None).cast("string")), x="a") == ""
    assert one(spark, S.catalog_aliases(x), x="rust") == K.DEFAULT_ALIASES and one(spark, S.type_kinds(x), x="go") == ["struct", "interface", "type"]
    assert one(spark, S.resource_signals(x), x="cpp") == [*K.COMMON_SIGNALS, "lookup", "fetch", "load"]
    kept = lambda langs, target: one(spark, S.language_compatible(x, F.lit(target)), x=langs)
    assert [kept(v, "python") for v in ([], ["Python"], ["C"], ["C", "Not Language-Specific"])] == [True, True, False, True]
    assert not kept(["Python"], "rust") and kept(["C"], "all")
    assert one(spark, S.extension(x), x="a/b.Tar.GZ") == ".gz" and one(spark, S.extension(x), x="a/.env") == "" and one(spark, S.extension(x), x="a.b/c") == ""
    assert one(spark, S.extension_language(x), x="A.PY") == "python" and one(spark, S.extension_language(x, lower=False), x="A.PY") is None
    assert one(spark, S.file_url(x), x="a\\b.py") == "file:///a/b.py" and one(spark, S.file_url(x, "/p/"), x="a/b.py") == "file:///p/a/b.py" and one(spark, S.hide_none(x), x="None") is None
    assert one(spark, S.weakness_label(x, F.lit("t")), x=["79", "89"]) == "CWE-79 / CWE-89" and one(spark, S.weakness_label(x, F.lit("t")), x=[]) == "t"
    assert one(spark, S.entrypoint(x, F.lit("src/a")), x="main") == "main" and one(spark, S.entrypoint(F.nullif(x, x), F.lit("src/a")), x="m") == "Reachability Hint: high"
    assert [one(spark, S.source_rank(x), x=v) for v in ("resource", "symbol", "vector", "both", "?")] == [0, 1, 2, 3, -1]
    assert one(spark, S.ignored_dir(x, True), x=".audit_temp/a") and not one(spark, S.ignored_dir(x), x=".audit_temp/a") and not one(spark, S.ignored_dir(x), x="Build/a")


def test_texts(spark):
    x = F.col("x")
    assert one(spark, S.keyword_fallback(x), x="Use of Hard-coded Key") == "Hard coded"
    assert one(spark, S.keyword_fallback(x), x="a b") == "a b" and one(spark, S.keyword_fallback(x, F.lit("")), x="a b") == ""
    assert one(spark, S.keyword_fallback(x), x="naïve_été ab") == "naïve_été"
    assert [one(spark, S.semantic_intents(x), x=v) for v in (["a b c"], ["a b c d"], [], ["x", " a  b c d "])] == [False, True, False, True]
    assert len(one(spark, S.preview(x), x="a" * 81)) == 80 and one(spark, S.preview(x), x="a" * 81).endswith("a...") and one(spark, S.preview(x), x="a" * 80) == "a" * 80
    floor = lambda v: one(spark, S.below_snippet_floor(x), x=v)
    assert floor("\n" * 6 + "a" * 29) and not floor("\n" * 5 + "a" * 30) and floor("\n" * 4 + "a" * 30) and floor("")
    names = lambda n, lang: one(spark, S.test_name(x, F.lit(lang)), x=n)
    assert names("mockingbird", "java") and names("TestX", "go") and names("TestX", "python") and not names("TestX", "java") and not names("contest", "python") and not names("test_a", "java")
    assert one(spark, S.clean_code(x), x="# head\n```python\n12\tdef f():\n13\t    pass\n```\n") == "def f():\n    pass"
    assert one(spark, S.clean_code(x), x="plain\ncode") == "plain\ncode"
    assert one(spark, S.clean_code(x), x="```\n12 x = 1\n13: y\n```") == "x = 1\n13: y" and one(spark, S.clean_code(x), x="```rust\n1\tz\n```") == "rust\nz"
    assert one(spark, S.embed_text(F.lit("f"), x), x="\n".join(map(str, range(60)))) == "f\n" + "\n".join(map(str, range(40)))
    assert one(spark, S.truncate_context(x), x="a" * 6001) == "a" * 6000 + "\n... (truncated)"
    assert one(spark, S.type_names(x, F.lit("c")), x="struct Foo { size_t n; vector<MyType> v; } std string") == ["Foo", "MyType", "size_t"]
    assert one(spark, S.type_names(x, F.lit("Python")), x="HTTPServer ID My_Type UserRepo class foo:") == ["HTTPServer", "ID", "My_Type", "UserRepo", "foo"]
    assert one(spark, S.type_names(x, F.lit("java")), x="record point(int x) u8_t") == ["point"] and one(spark, S.type_names(x, F.lit("rust")), x="Foo") == []
    header = lambda v, strict=False: one(spark, S.header_name(x, strict), x=v)
    assert header("  def outer(a):") == "outer" and header("func (s *T) Get(x int) {") == "Get" and header("const go = async (a) => {") == "go" and header("static int f(void)") == "f"
    assert header("    return json(x)") == "json" and header("    return json(x)", True) is None and header("else if (x)", True) is None and header("x = 1") is None
    assert one(spark, S.word_bounded(x, "user_id"), x="a user_id)") and not one(spark, S.word_bounded(x, "user_id"), x="my_user_id")
    assert one(spark, S.signal_hit(x, "db\\.(Where|First)\\("), x="db.First(") and one(spark, S.module_label(x, F.lit(3)), x="a.py") == "[module-level] a.py:3"


def test_adaptive_k(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 50, 100, 130, 150, 217, 600, 2000)], "n long").select(S.adaptive_k(F.col("n"))).collect()
    assert [r[0] for r in got] == [30, 5, 5, 5, 6, 8, 11, 30, 30]


def test_triage_all_votes(spark):
    one_vote = list(itertools.product([True, False], repeat=3))
    rows = [(i, *v) for i, vs in enumerate(itertools.product(one_vote, repeat=3)) for v in vs]
    got = {r.candidate_id: r.verdict for r in M.tally_votes(spark.createDataFrame(rows, "candidate_id int, is_real boolean, has_path boolean, has_missing boolean")).collect()}
    for i, votes in enumerate(itertools.product(one_vote, repeat=3)):
        n, path, missing = sum(v[0] for v in votes), any(v[0] and v[1] for v in votes), any(v[2] for v in votes)
        assert got[i] == ("verified" if n >= 2 and path else "needs_review" if n or missing else "false_positive")


def test_symbols_and_owners(spark):
    listing = [("f", "- `load_user` (function) — :12"), ("f", "- `get` (method) (res, request) — :7"), ("f", "- `x` (function) — :abc"), ("f", "- `User` (class) — :3")]
    got = L.parse_symbol_listing(spark.createDataFrame(listing, "file string, row string")).collect()
    assert sorted((r.name, r.line) for r in got) == [("get", 7), ("load_user", 12), ("x", 1)]
    symbols = spark.createDataFrame([("f", "a", 10, 1), ("f", "b", 20, 2), ("f", "b2", 20, 3)], "file string, name string, line int, listing_ord long")
    hits = spark.createDataFrame([("f", n) for n in (5, 10, 19, 20, 99)] + [("g", 1)], "file string, line_no long")
    assert sorted((r.line_no, r.function) for r in L.owning_symbol(hits, symbols).collect()) == [(10, "a"), (19, "a"), (20, "b2"), (99, "b2")]
    gaps = L.coverage_gaps(hits, symbols, spark.createDataFrame([("f", "a")], "file string, function string")).collect()
    assert sorted(r.line_no for r in gaps) == [20, 99]


SOURCE = "import os\ndef outer(a):\n    x = db.get_by_id(a)\n    return json(x)\ndef inner(b):\n    y = 1"


def test_enclosing_and_usages(spark):
    lines = L.explode_lines(spark.createDataFrame([("p.py", SOURCE)], "file string, content string"), ["file"])
    by = lambda **k: {r.line_no: r.enclosing for r in L.enclosing_header(lines, **k).collect()}
    assert by() == {1: "[module-level] p.py:1", 2: "outer", 3: "outer", 4: "json", 5: "inner", 6: "inner"}
    assert by(exclude="outer")[2] == "[module-level] p.py:2" and by(strict=True)[4] == "outer"
    used = L.usages(lines, ["get_by_id", "json", "outer", r"db\.get"]).collect()
    assert sorted((r.signal, r.enclosing, r.line_no) for r in used) == [(r"db\.get", "outer", 3), ("get_by_id", "outer", 3), ("json", "json", 4)]
    symbols = L.symbols_of(lines)
    code = {r.name: (r.line, r.code) for r in L.symbol_sources(symbols, lines).collect()}
    assert code == {"outer": (2, "\n".join(SOURCE.split("\n")[1:4])), "inner": (5, "\n".join(SOURCE.split("\n")[4:]))}
    assert L.usages(lines, []).count() == 0


def test_recall_sources(spark):
    cases = {"a": ["vector"], "b": ["vector", "symbol"], "c": ["symbol", "vector"], "d": ["symbol", "symbol"], "e": ["vector", "resource"], "f": ["resource", "resource"]}
    rows = [(k, road, i, f"file{i}") for k, roads in cases.items() for i, road in enumerate(roads)]
    got = M.recall_union(spark.createDataFrame(rows, "name string, road string, recall_ord int, file string"), ["name"]).collect()
    assert {r.name: r.recall_source for r in got} == {"a": "vector", "b": "both", "c": "both", "d": "symbol", "e": "both", "f": "resource"}
    assert all(r.file == "file0" for r in got)


def test_candidate_dedup(spark):
    rows = [("f.py", "g", "79", "symbol", 0, "first"), ("f.py", "g", "89", "vector", 1, "second"), ("f.py", "g", "79", "resource", 2, "third"), ("h.py", "g", "639", "resource", 3, "other")]
    df = spark.createDataFrame(rows, "file string, function string, cwe_id string, recall_source string, ord long, code string")
    out = M.numbered(M.dedup_candidates(df, ["file", "function"], "ord"), ["ord"], "cand-uniq-")
    got = [(r.id, r.file, r.matched_cwes, r.recall_source, r.cwe_id, r.code) for r in out.orderBy("ord").collect()]
    assert got == [("cand-uniq-1", "f.py", ["79", "89"], "vector", "79", "first"), ("cand-uniq-2", "h.py", ["639"], "resource", "639", "other")]
    again = M.dedup_candidates(out.drop("id", "matched_cwes"), ["file", "function"], "ord")
    assert again.count() == 2


def test_cosine(spark):
    r = 2**-0.5
    index = spark.createDataFrame([("f", "v1", [1.0, 0.0]), ("f", "v2", [0.0, 1.0]), ("f", "v3", [r, r]), ("f", "v4", [-1.0, 0.0])], "file string, name string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "intent_id string, query array<float>")
    top = lambda k, floor: [x.name for x in R.cosine_top_k(index, q, k, floor).orderBy("rank").collect()]
    assert top(2, 0.6) == ["v1", "v3"] == top(3, 0.6) and top(2, 0.9) == ["v1"] and top(9, None) == ["v1", "v3", "v2", "v4"]
    assert R.cosine_top_k(index.limit(0), q, 3).count() == 0
    old = R.INTENT_BLOCK
    try:
        R.INTENT_BLOCK = 2
        many = spark.createDataFrame([(f"q{i}", [1.0, float(i)]) for i in range(7)], "intent_id string, query array<float>")
        assert R.cosine_top_k(index, many, 1).count() == 7
    finally:
        R.INTENT_BLOCK = old


def test_prune_and_tags(spark):
    mapping = spark.createDataFrame([("net", "601"), ("net", "611"), ("ser", "611"), ("ser", "502")], "tag string, id string")
    catalog = spark.createDataFrame([(c,) for c in ("601", "611", "502", "999")], "id string")
    kept = lambda tags: sorted(r.id for r in R.prune(catalog, mapping, spark.createDataFrame([(t,) for t in tags], "tag string")).collect())
    assert kept(["ser"]) == ["502", "611", "999"] and kept([]) == ["999"] and kept(["net"]) == ["601", "611", "999"]
    files = spark.createDataFrame([("x", "uses PTHREAD and Json"), ("y", None)], "path string, content string")
    assert {r.tag for r in R.found_tags(files).where("found").collect()} == {"concurrency", "serialization"}
    assert not {r.tag for r in R.found_tags(files.limit(0)).where("found").collect()}


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), ("e", "h5")], "path string, md5 string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("d", "h4"), ("e", None)], "path string, md5 string")
    assert {r.path: r.state for r in R.compare_snapshots(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new", "e": "changed"}


def test_resource_quota(spark):
    rng, rows, known, want = random.Random(1), [], [], {}
    for t in range(25):
        names = [f"n{i}" for i in range(26)]
        have = rng.sample(names, 5)
        known += [(t, n) for n in have]
        seen, out = set(have), []
        events = [(t, s, p, o, rng.choice(names), f"f{rng.randrange(2)}") for s in range(5) for p in range(2) for o in range(6)]
        rows += events
        for s in range(5):
            if len(out) >= 8:
                break
            for e in (e for e in events if e[1:3] == (s, 0)):
                if len(out) < 8 and e[4] not in seen:
                    seen.add(e[4])
                    out.append(e[4])
            pairs = list(dict.fromkeys((e[4], e[5]) for e in events if e[1:3] == (s, 1)))[: 8 - len(out)]
            for n, _ in pairs:
                if n not in seen:
                    seen.add(n)
                    out.append(n)
        want[t] = sorted(out)
    ev = spark.createDataFrame(rows, "task_id int, signal_ord int, phase int, ord int, name string, file string")
    kn = spark.createDataFrame(known, "task_id int, name string")
    got = {}
    for r in R.resource_quota(ev, kn, 8).collect():
        got.setdefault(r.task_id, []).append(r.name)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all(r["count"] <= 8 for r in R.ordered_quota(ev, kn, 8).groupBy("task_id").count().collect())


def test_verdict_merge(spark):
    c = spark.createDataFrame([("c1", "pending", "", "e0", ["v"]), ("c2", "pending", "", None, None), ("c3", "pending", "", None, None)], "id string, verdict string, explanation string, entrypoint string, votes array<string>")
    u = spark.createDataFrame([(0, None, ["c1", "c2"], "needs_review", "x", None, None), (1, "c1", None, "verified", "y", "e1", None), (2, "zz", None, "verified", "z", None, None)],
                              "pos int, candidate_id string, candidate_ids array<string>, verdict string, explanation string, entrypoint string, votes array<string>")
    got = {r.id: (r.verdict, r.explanation, r.entrypoint, r.votes) for r in M.merge_verdicts(c, M.expand_updates(u)).collect()}
    assert got == {"c1": ("verified", "y", "e1", ["v"]), "c2": ("needs_review", "x", None, None), "c3": ("pending", "", None, None)}
    clear = spark.createDataFrame([("c1", "verified", "q", [])], "id string, verdict string, explanation string, votes array<string>")
    assert M.merge_verdicts(c, clear).where("id = 'c1'").first().votes == []
    assert M.merge_verdict(c, "c2", "verified", "e").where("id = 'c2'").first().verdict == "verified"
    with pytest.raises(KeyError):
        M.merge_verdict(c, "zz", "verified")
    with pytest.raises(ValueError):
        M.merge_verdict(c, "c1", "maybe")


def test_verify(spark):
    c = spark.createDataFrame([("c1", "f", "g", "79", "pending", 1), ("c2", "f", "g", "79", "pending", 2), ("c3", "f", "h", "79", "pending", 3), ("c4", "f", "i", "79", "verified", 4), ("c5", "f", "j", "79", "pending", 5), ("c6", "f", "k", "79", "pending", 6)],
                              "id string, file string, function string, cwe_id string, verdict string, ord int")
    votes = spark.createDataFrame([("c1", x, True, i == 0, False, "why" if i == 1 else "") for i, x in enumerate(("reachability", "guard", "exploit"))], "candidate_id string, lens string, is_real boolean, has_path boolean, has_missing boolean, reason string")
    severity = spark.createDataFrame([("c1", 5), ("c3", 4)], "candidate_id string, severity int")
    got = {r.candidate_id: (r.verdict, r.explanation) for r in M.verify(c, severity, votes, limit=3).collect()}
    lenses = "\n1. reachability: {}\n2. guard: {}\n3. exploit: {}"
    real = "Verified logic vulnerability (votes 3/3)." + lenses.format("n/a", "why", "n/a")
    none = "Excluded — all lenses falsified the vulnerability (votes 0/3)." + lenses.format("n/a", "n/a", "n/a")
    low = "Excluded — Security severity rated as 4/10 (below audit threshold 5).\nReason: n/a"
    assert got == {"c1": ("verified", real), "c2": ("verified", real), "c3": ("false_positive", low), "c5": ("false_positive", none)}
    assert M.truncated(c, 3) == 1 and M.truncated(c, 9) == 0
    assert M.verify(c, severity, votes, strict=True).where("candidate_id = 'c5'").first().verdict == "needs_review"
    counts = M.bucket_counts(spark.createDataFrame([("verified",), ("odd",), (None,)], "verdict string")).first()
    assert (counts.total, counts.verified, counts.needs_review, counts.false_positive, counts.pending) == (3, 1, 0, 0, 2)


def test_callers_fall_back(spark):
    rows = [("a", "x", "f", 1, False), ("b", "x", "f", 2, True), ("c", "y", "f", 3, True)] + [(f"d{i}", "z", "f", i, False) for i in range(12)]
    got = M.neighbours(spark.createDataFrame(rows, "src string, dst string, file string, ord int, is_fallback boolean")).collect()
    by = {d: [r.src for r in got if r.dst == d] for d in "xyz"}
    assert by["x"] == ["a"] and by["y"] == ["c"] and len(by["z"]) == 10


def test_header_forms_as_one_pattern(spark):
    """The one pattern for all header forms names what the forms tried one by one do."""
    rng, bits = random.Random(3), ["def", "func", "function", "const", "let", "async", "=>", "=", "(", ")", "*", " ", "  ", "\t", "foo", "b_1", "é", ":", "return", "if", "int", "(a)", "fn("]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["func (s *T) run()", "const f = async (a) => 1", "static int * go (void)", "def x", "defx(", "def fooé("]
    first = lambda forms: F.coalesce(*(F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in forms))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", S.header_name(F.col("t")), S.defined_name(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in rows.select("t", first(K.HEADERS), first(K.HEADERS[:4])).collect()]
    strict = F.when(~F.col("t").rlike(r"^\s*(return|else|if|for|while|switch|case|throw|new|await|yield|do|goto|delete|not|and|or|in|raise|assert|print)\b") & ~first(K.HEADERS[4:]).isin("if", "for", "while", "switch", "return", "catch", "sizeof"), first(K.HEADERS[4:]))
    assert rows.select(S.header_name(F.col("t"), True)).collect() == rows.select(F.coalesce(first(K.HEADERS[:4]), strict)).collect()


def test_usages_read_lines_once(spark):
    rows = spark.range(5).selectExpr("id AS file", "id AS line_no", "'x = eval(a)' AS line")
    plan = L.usages(rows, ["eval"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and L.by_file(rows, "file", 50_000_000)._jdf.queryExecution().toString().count(", 50") >= 1
