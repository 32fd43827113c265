"""More queries with SQL twins: the audit's own operators over stand-ins for files, code lines and plans.

Parts stand for files (a path made of the size and the key), line items for lines of code, orders for
candidates. Every query goes through the library's operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import scalars as S
from lodestone.operators import lines as L
from lodestone.operators import merging as M
from lodestone.operators import retrieval as R
from lodestone.plans import audit, report
from lodestone.plans.catalog import query, quoted, table
from lodestone.sources import files as sources

_DIRS = ["src/api/", "tests/", "Lib/Web/", "node_modules/x/", "tools/", "pkg/"]
_ENDS = [".py", ".js", ".min.js", ".c", ".h", ".cpp", ".java", ".go", ".ts", ".PY", ".txt"]
_FILES = f"SELECT p_partkey AS id, [{quoted(_DIRS)}][p_size % 6 + 1] || 'f' || p_partkey || [{quoted(_ENDS)}][p_partkey % 11 + 1] AS path FROM part"
_GENERATED = r"(regexp_matches(lower(path), '(\.min\.js|\.min\.css|\.map|\.bundle\.js)$') OR position('.min.' IN lower(path)) > 0)"
_EXT = r"regexp_extract(path, '(\.[^./]*)$', 1)"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _files(spark, d) -> DataFrame:
    path = F.concat(_pick(_DIRS, F.col("p_size")), F.lit("f"), F.col("p_partkey").cast("string"), _pick(_ENDS, F.col("p_partkey")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))


@query(f"SELECT id, path FROM ({_FILES}) WHERE lower({_EXT}) IN ('.py', '.js', '.ts') AND NOT list_has_any(string_split(lower(path), '/'), [{quoted(K.INDEX_BLACKLIST)}])")
def index_file_filter(spark, d):
    return sources.index_files(_files(spark, d), [".py", ".js", ".ts"])


@query(rf"""
SELECT id, path FROM ({_FILES}) WHERE {_EXT} IN ({quoted(S.source_extensions())}) AND NOT list_has_any(string_split(path, '/'), [{quoted(K.PRESCAN_IGNORE)}])
AND NOT regexp_matches(lower(path), '(\.min\.js|\.min\.css|\.map|\.bundle\.js)$') AND position('.min.' IN lower(path)) = 0
""")
def prescan_file_filter(spark, d):
    """Source files of all languages, outside ignored folders, not generated."""
    return sources.prescan_files(_files(spark, d), S.source_extensions())


def _case(key: str, mapping: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query(f"SELECT id, path, {_case(f'lower({_EXT})', K.EXTENSION_LANGUAGE)} AS language, {_case(f'lower({_EXT})', K.SINK_EXTENSIONS)} AS sink_language FROM ({_FILES})")
def file_language(spark, d):
    return _files(spark, d).select("id", "path", S.extension_language(F.col("path")).alias("language"), S.extension_language(F.col("path"), True).alias("sink_language"))


@query(f"""
SELECT lang, count(*) AS n FROM (SELECT {_case(f'lower({_EXT})', K.EXTENSION_LANGUAGE)} AS lang, path FROM ({_FILES}))
WHERE lang IS NOT NULL AND NOT list_has_any(string_split(path, '/'), [{quoted(K.PRESCAN_IGNORE)}]) AND NOT {_GENERATED} GROUP BY 1
""")
def language_counts(spark, d):
    return sources.language_counts(_files(spark, d))


@query(f"""
SELECT id, path FROM ({_FILES}) WHERE {_case(f'lower({_EXT})', K.SINK_EXTENSIONS)} = 'c/cpp' AND NOT list_has_any(string_split(path, '/'), [{quoted(K.COVERAGE_IGNORE)}])
""")
def coverage_file_filter(spark, d):
    return sources.coverage_files(_files(spark, d), "c/cpp")


_REACH = f"CASE WHEN list_has_any(string_split(lower(path), '/'), [{quoted(K.REACH_LOW)}]) THEN 'low' WHEN list_has_any(string_split(lower(path), '/'), [{quoted(K.REACH_HIGH)}]) THEN 'high' ELSE 'medium' END"


@query(f"""
SELECT id, {_REACH} AS reachability, CASE WHEN id % 3 = 0 THEN 'caller' || id ELSE 'Reachability Hint: ' || {_REACH} END AS entrypoint,
       'file:///work/project/' || path AS url, '[module-level] ' || path || ':' || id AS label FROM ({_FILES})
""")
def file_entrypoints(spark, d):
    """Reachability of each file, its entry point (a caller first), its link and its module-level label."""
    path = F.col("path")
    caller = F.when(F.col("id") % 3 == 0, F.concat(F.lit("caller"), F.col("id").cast("string")))
    return _files(spark, d).select(
        "id", S.reachability(path).alias("reachability"), S.entrypoint(caller, path).alias("entrypoint"), S.file_url(path, "/work/project").alias("url"), S.module_label(path, F.col("id")).alias("label")
    )


_NAMES = ["Python", "TS", "typescript", "JavaScript", "go", "Rust", "", "C", "java"]
_NORM = f"coalesce({_case('lower(coalesce(name, chr(0)))', K.LANGUAGE_ALIASES)}, lower(coalesce(name, '')))"


@query(f"""
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 < 9 THEN [{quoted(_NAMES)}][doc_id % 10 + 1] END AS name FROM documents), m AS (SELECT doc_id, {_NORM} AS language FROM n)
SELECT doc_id, language, coalesce({_case('language', K.MARKDOWN_TAGS)}, '') AS tag,
       CASE language {' '.join(f"WHEN '{k}' THEN '{'|'.join(v[1])}'" for k, v in K.LANGUAGES.items())} ELSE '{'|'.join(K.DEFAULT_ALIASES)}' END AS aliases,
       CASE language {' '.join(f"WHEN '{k}' THEN '{'|'.join(v[2])}'" for k, v in K.LANGUAGES.items())} ELSE '' END AS kinds FROM m
""")
def language_names(spark, d):
    """Spellings of languages: their normal form, fence tag, catalog aliases and kinds of types."""
    at = F.col("doc_id") % 10
    name = F.when(at < 9, F.get(F.array(*map(F.lit, _NAMES)), at.cast("int")))
    return table(spark, d, "documents").select(
        "doc_id", S.normalise_language(name).alias("language"), S.markdown_tag(name).alias("tag"), F.array_join(S.catalog_aliases(name), "|").alias("aliases"), F.array_join(S.type_kinds(name), "|").alias("kinds")
    )


@query(f"""
SELECT doc_id FROM documents WHERE doc_id % 5 IN (0, 1) OR list_has_any(CASE doc_id % 5 WHEN 2 THEN ['Python'] WHEN 3 THEN ['Java', 'C++'] ELSE ['Rust', 'Not Language-Specific'] END, [{quoted(K.LANGUAGES['python'][1])}])
""")
def language_filter(spark, d):
    """Catalog entries for Python: without languages, or with one of its aliases."""
    at = F.col("doc_id") % 5
    given = F.when(at == 1, F.array().cast("array<string>")).when(at == 2, F.array(F.lit("Python"))).when(at == 3, F.array(F.lit("Java"), F.lit("C++"))).when(at == 4, F.array(F.lit("Rust"), F.lit("Not Language-Specific")))
    return table(spark, d, "documents").where(S.language_compatible(given, F.lit("python"))).select("doc_id")


_PREFIXES = ["test_", "Test", "mock", "BM_", "TEST", "unittest", "benchmark", "", "TestCase", "latest_"]
_TESTED = " OR ".join(f"contains(name, '{w}')" for w in K.TEST_KEYWORDS)


@query(f"""
WITH n AS (SELECT p_partkey, [{quoted(_PREFIXES)}][p_partkey % 10 + 1] || p_name AS name, ['python', 'go', 'java', 'TypeScript'][p_size % 4 + 1] AS language FROM part)
SELECT p_partkey, name, ({_TESTED}) OR (language = 'go' AND starts_with(name, 'Test')) OR (language = 'python' AND starts_with(lower(name), 'test')) AS is_test FROM n
""")
def test_name_marks(spark, d):
    name = F.concat(_pick(_PREFIXES, F.col("p_partkey")), "p_name")
    return table(spark, d, "part").select("p_partkey", name.alias("name"), S.test_name(name, _pick(["python", "go", "java", "TypeScript"], F.col("p_size"))).alias("is_test"))


_PATHS = ["src/a.py", "tests/a.py", "src/a.txt", "lib/b.PY"]


@query(rf"""
SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 3) AND doc_id % 7 <> 0
AND NOT (text IS NULL OR length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) < 30 OR len(string_split(text, chr(10))) < 6)
""")
def boilerplate_filter(spark, d):
    """Snippets that are no boilerplate: by extension, folder, name and size together."""
    path, name = _pick(_PATHS, F.col("doc_id")), F.when(F.col("doc_id") % 7 == 0, "test_x").otherwise("run")
    return table(spark, d, "documents").where(~S.boilerplate(path, name, F.col("text"), F.lit("python"), [".py"])).select("doc_id")


_KINDS = ["function", "method", "class"]


@query(f"""
SELECT p_partkey AS file, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE p_size END AS line FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 7 <> 0
""")
def symbol_listing(spark, d):
    """Functions and methods of listing rows; a row without a number counts as line 1, other kinds do not count."""
    key = F.col("p_partkey")
    number = F.when(key % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))
    row = F.concat(F.when(key % 7 == 0, "# ").otherwise("- "), F.lit("`"), "p_name", F.lit("` ("), _pick(_KINDS, key), F.lit(") - :"), number)
    return L.parse_symbol_listing(table(spark, d, "part").select(key.alias("file"), row.alias("row")))


_CODE = """
SELECT l_orderkey AS file, l_linenumber::BIGINT AS line_no, CASE l_linenumber % 3
  WHEN 1 THEN 'def fn_' || (min(l_partkey) % 50) || '(a):' WHEN 2 THEN '    row = findById(fn_' || (min(l_suppkey) % 50) || '(b))' ELSE '    eval(x, fn_' || (min(l_partkey) % 50) || ')' END AS line
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""
_HEADED = f"""
c AS ({_CODE}),
h AS (SELECT file, line_no, regexp_extract(line, '^def ([A-Za-z0-9_]+)', 1) AS name FROM c WHERE starts_with(line, 'def ')),
e AS (SELECT c.file, c.line_no, c.line, h.name AS owner, coalesce(h.name, '[module-level] ' || c.file || ':' || c.line_no) AS enclosing FROM c ASOF LEFT JOIN h ON c.file = h.file AND c.line_no >= h.line_no)
"""


def _code(spark, d) -> DataFrame:
    """Lines of code of ``file``: headers, calls and mentions of fifty functions."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    each = L.by_file(items, "l_orderkey", items.count()).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    name = lambda c: F.concat(F.lit("fn_"), (F.col(c) % 50).cast("string"))
    at = F.col("l_linenumber") % 3
    line = F.when(at == 1, F.concat(F.lit("def "), name("p"), F.lit("(a):"))).when(at == 2, F.concat(F.lit("    row = findById("), name("s"), F.lit("(b))"))).otherwise(F.concat(F.lit("    eval(x, "), name("p"), F.lit(")")))
    return each.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), line.alias("line"))


@query(f"WITH {_HEADED} SELECT file, name, line_no::INT AS line FROM h")
def header_symbols(spark, d):
    return L.symbols_of(_code(spark, d))


@query(f"WITH {_HEADED} SELECT file, name, min(line_no)::INT AS line FROM h GROUP BY 1, 2")
def first_symbols(spark, d):
    return L.first_symbols(L.symbols_of(_code(spark, d)), [F.col("line")])


@query(f"""
WITH {_HEADED}, s AS (SELECT e.file, e.owner AS name, max(h.line_no) AS line, e.line_no, any_value(e.line) AS t FROM e JOIN h ON e.file = h.file AND h.line_no <= e.line_no GROUP BY e.file, e.owner, e.line_no)
SELECT file, name, line::INT AS line, string_agg(t, chr(10) ORDER BY line_no) AS code FROM s GROUP BY 1, 2, 3
""")
def symbol_sources(spark, d):
    """Each function with its lines."""
    lines = _code(spark, d)
    return L.symbol_sources(L.symbols_of(lines), lines)


@query(f"""
WITH {_HEADED}, u AS (SELECT file, 'eval' AS signal, enclosing, min(line_no) AS line_no FROM e WHERE contains(line, 'eval(') GROUP BY ALL
  UNION ALL SELECT file, 'findById', enclosing, min(line_no) FROM e WHERE contains(line, 'findById(') GROUP BY ALL
  UNION ALL SELECT file, 'row = find\\w+', enclosing, min(line_no) FROM e WHERE contains(line, 'row = findById') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY file, line_no) AS k FROM u)
SELECT file, signal, enclosing, line_no FROM r WHERE k <= 40
""")
def usages_limited(spark, d):
    """The first forty uses of two words and a pattern, one in each enclosing function."""
    return L.usages(_code(spark, d), ["eval", "findById", r"row = find\w+"])


_EDGES = """
x AS (SELECT file, line_no, owner AS src, unnest(list_distinct(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS dst FROM e WHERE owner IS NOT NULL),
g AS (SELECT src, dst, file, min(line_no) AS line FROM x WHERE src <> dst AND dst IN (SELECT name FROM h) GROUP BY 1, 2, 3)
"""


@query(f"WITH {_HEADED}, {_EDGES} SELECT src, dst, file, line FROM g")
def call_edges(spark, d):
    lines = _code(spark, d)
    return audit.call_edges(lines, L.symbols_of(lines))


@query(f"""
WITH {_HEADED}, {_EDGES}, bare AS (SELECT DISTINCT name AS dst FROM h WHERE name NOT IN (SELECT dst FROM g)),
w AS (SELECT file, line_no, enclosing, CASE WHEN starts_with(line, 'def ') THEN regexp_extract(line, '^def ([A-Za-z0-9_]+)', 1) ELSE '' END AS own, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))) AS dst FROM e),
m AS (SELECT DISTINCT w.file, w.line_no, w.dst FROM w JOIN bare USING (dst) WHERE NOT (own <> '' AND contains(w.dst, own))),
o AS (SELECT m.file, m.line_no, m.dst, arg_max(h.name, h.line_no) AS src FROM m LEFT JOIN h ON h.file = m.file AND h.line_no <= m.line_no AND h.name <> m.dst GROUP BY 1, 2, 3),
f AS (SELECT coalesce(src, '[module-level] ' || file || ':' || line_no) AS src, dst, file, min(line_no) AS line FROM o GROUP BY 1, 2, 3),
a AS (SELECT src, dst, file, line, false AS is_fallback FROM g UNION ALL SELECT src, dst, file, line, true FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY file, line, src) AS rank FROM a)
SELECT src, dst, file, line, is_fallback, rank FROM r WHERE rank <= 10
""")
def callers_or_mentions(spark, d):
    """Up to ten callers of each function; where nobody calls it, functions that name it."""
    lines = _code(spark, d)
    symbols = L.symbols_of(lines)
    out = audit.callers_of(symbols.select(F.col("name").alias("dst")), audit.call_edges(lines, symbols), lines)
    return out.select("src", "dst", "file", "line", "is_fallback", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_HEADED}, s AS (SELECT * FROM e WHERE contains(line, 'eval(') AND owner IS NOT NULL)
SELECT file, line_no, owner AS function, line FROM s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.file AND s.owner = 'fn_' || (o.o_custkey % 50)) AND file % 3 <> 0
UNION ALL SELECT file, line_no, owner, line FROM s WHERE file % 3 = 0
""")
def sink_gaps(spark, d):
    """Sink lines whose function no candidate covers, by file and function."""
    lines = _code(spark, d)
    hits = lines.where(F.col("line").rlike(K.SINKS["python"]))
    symbols = L.symbols_of(lines).withColumn("listing_ord", F.col("line").cast("long"))
    recalled = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("fn_"), (F.col("o_custkey") % 50).cast("string")).alias("function"))
    return L.coverage_gaps(hits, symbols, recalled)


_FENCED = r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  plain ' || source || ' ' WHEN 1 THEN 'head ```python' || chr(10) || '12 ' || source || chr(10) || '13: ' || lang || chr(10) || '```'
  WHEN 2 THEN '```rust' || chr(10) || '7' || chr(9) || source || '``` tail' ELSE '```' || chr(10) || chr(10) || '  9 ' || source || '```' END AS block FROM documents
"""


@query(r"""
SELECT doc_id, CASE WHEN source IS NULL OR (lang IS NULL AND doc_id % 4 = 1) THEN '' ELSE CASE doc_id % 4 WHEN 0 THEN 'plain ' || source WHEN 1 THEN source || chr(10) || '13: ' || lang WHEN 2 THEN 'rust' || chr(10) || source ELSE chr(10) || '  9 ' || source END END AS code FROM documents
""")
def clean_code(spark, d):
    """Code taken out of fenced blocks: tag lines and line numbers go, other text stays."""
    at, nl = F.col("doc_id") % 4, F.lit("\n")
    block = (
        F.when(at == 0, F.concat(F.lit("  plain "), "source", F.lit(" ")))
        .when(at == 1, F.concat(F.lit("head ```python\n12 "), "source", F.lit("\n13: "), "lang", F.lit("\n```")))
        .when(at == 2, F.concat(F.lit("```rust\n7\t"), "source", F.lit("``` tail")))
        .otherwise(F.concat(F.lit("```\n\n  9 "), "source", F.lit("```")))
    )
    return table(spark, d, "documents").select("doc_id", S.clean_code(block).alias("code"))


@query("""
SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'CWE-' || o_orderstatus || ' / CWE-' || o_orderpriority WHEN 1 THEN 'CWE-' || o_orderstatus ELSE 'CWE-9: x' END AS label,
       nullif(CASE WHEN o_orderkey % 2 = 0 THEN 'None' ELSE o_orderstatus END, 'None') AS shown FROM orders
""")
def weakness_labels(spark, d):
    """Labels of one, two or no classes, and the literal None hidden."""
    at = F.col("o_custkey") % 3
    classes = F.when(at == 0, F.array("o_orderstatus", "o_orderpriority")).when(at == 1, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>"))
    shown = S.hide_none(F.when(F.col("o_orderkey") % 2 == 0, "None").otherwise(F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", S.weakness_label(classes, F.lit("CWE-9: x")).alias("label"), shown.alias("shown"))


_RULE_ROWS = ", ".join(f"('{tag}', '{c}')" for tag, (_, classes) in K.PRESCAN_RULES.items() for c in classes)


@query(f"""
WITH w AS (SELECT p_partkey, (p_partkey % 1100)::VARCHAR AS id FROM part), r AS (SELECT * FROM (VALUES {_RULE_ROWS}) r(tag, id))
SELECT p_partkey, id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM w JOIN r USING (id) GROUP BY 1, 2
""")
def tags_of_classes(spark, d):
    """The tags that call for each catalog row's weakness class; rows whose class no rule names are left out."""
    weaknesses = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1100).cast("string").alias("id"))
    rules = R.rule_classes(spark).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return weaknesses.join(F.broadcast(rules), "id").select("p_partkey", "id", "tags")


@query("""
WITH m AS (SELECT DISTINCT p_brand AS tag, p_partkey % 97 AS id FROM part WHERE p_partkey % 3 = 0), f AS (SELECT DISTINCT p_brand AS tag FROM part WHERE p_brand < 'Brand#2')
SELECT p_partkey, p_partkey % 97 AS id FROM part WHERE p_partkey % 97 NOT IN (SELECT id FROM m) OR p_partkey % 97 IN (SELECT id FROM m JOIN f USING (tag))
""")
def rule_prune_classes(spark, d):
    """Classes that no brand maps, or that a found brand maps; the others go."""
    part = table(spark, d, "part")
    mapping = part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("tag"), (F.col("p_partkey") % 97).alias("id"))
    found = part.where("p_brand < 'Brand#2'").select(F.col("p_brand").alias("tag"))
    return R.prune(part.select("p_partkey", (F.col("p_partkey") % 97).alias("id")), mapping, found).select("p_partkey", "id")


@query("""
WITH o AS (SELECT doc_id AS path, md5(text) AS h FROM documents), n AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.path = n.path
""")
def snapshot_states(spark, d):
    """Every file of two snapshots of the whole table; in the later one some ids moved and some texts were edited."""
    docs = table(spark, d, "documents")
    later = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return R.compare_snapshots(docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("md5")), docs.select(moved.alias("path"), F.md5(later).alias("md5")))


_CANDIDATES = "SELECT o_orderkey::VARCHAR AS id, o_orderkey AS ord, o_custkey::VARCHAR AS file, o_orderpriority AS function, (o_orderkey % 3)::VARCHAR AS cwe_id, CASE o_orderstatus WHEN 'F' THEN 'verified' ELSE 'pending' END AS verdict FROM orders"
_LENS = "CASE l_linenumber WHEN 1 THEN 'reachability' WHEN 2 THEN 'guard' ELSE 'exploit' END"


def _candidates(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("file"), F.col("o_orderpriority").alias("function"),
        (F.col("o_orderkey") % 3).cast("string").alias("cwe_id"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("pending").alias("verdict"),
    )


@query(f"""
WITH c AS ({_CANDIDATES}), p AS (SELECT * FROM c WHERE verdict = 'pending'),
k AS (SELECT file, function, cwe_id, arg_min(id, ord) AS id, min(ord) AS ord FROM p GROUP BY 1, 2, 3 ORDER BY ord LIMIT 200),
t AS (SELECT l_orderkey::VARCHAR AS id, count_if(l_returnflag = 'R') AS n, bool_or(l_returnflag = 'R' AND l_quantity > 25) AS path, bool_or(l_discount > 0.08) AS missing,
  coalesce(min(l_linestatus) FILTER ({_LENS} = 'reachability' AND l_tax > 0.04), 'n/a') AS a, coalesce(min(l_linestatus) FILTER ({_LENS} = 'guard' AND l_tax > 0.04), 'n/a') AS b,
  coalesce(min(l_linestatus) FILTER ({_LENS} = 'exploit' AND l_tax > 0.04), 'n/a') AS c FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
j AS (SELECT k.file, k.function, k.cwe_id, k.ord % 11 AS sev, k.ord % 4 = 0 AS known, CASE WHEN n >= 2 AND path THEN 'verified' WHEN n >= 1 OR missing THEN 'needs_review' ELSE 'false_positive' END AS v,
  coalesce(n, 0) AS n, coalesce(a, 'n/a') AS a, coalesce(b, 'n/a') AS b, coalesce(c, 'n/a') AS c FROM k LEFT JOIN t USING (id))
SELECT p.id AS candidate_id, CASE WHEN known AND sev < 5 THEN 'false_positive' ELSE v END AS verdict,
  CASE WHEN known AND sev < 5 THEN 'Excluded — Security severity rated as ' || sev || '/10 (below audit threshold 5).' || chr(10) || 'Reason: low'
  ELSE {_case('v', K.VERDICT_HEADS)} || ' (votes ' || n || '/3).' || chr(10) || '1. reachability: ' || a || chr(10) || '2. guard: ' || b || chr(10) || '3. exploit: ' || c END AS explanation
FROM p JOIN j USING (file, function, cwe_id)
""")
def review(spark, d):
    """Verdicts of pending candidates: one a key judged, within the budget, by severity and then by votes."""
    severities = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("candidate_id"), (F.col("o_orderkey") % 11).alias("severity"), F.lit("low").alias("reason"))
    number = F.col("l_linenumber")
    votes = table(spark, d, "lineitem").where("l_linenumber <= 3").select(
        F.col("l_orderkey").cast("string").alias("candidate_id"), F.when(number == 1, "reachability").when(number == 2, "guard").otherwise("exploit").alias("lens"),
        (F.col("l_returnflag") == "R").alias("is_real"), (F.col("l_quantity") > 25).alias("has_path"), (F.col("l_discount") > 0.08).alias("has_missing"), F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).alias("reason"),
    )
    return M.verify(_candidates(spark, d), severities, votes, limit=K.REVIEW_BUDGET)


@query(f"""
WITH c AS ({_CANDIDATES}), u AS (SELECT unnest([l_orderkey, l_orderkey + 1]) AS id, l_orderkey * 10 + l_linenumber AS pos, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber),
w AS (SELECT id::VARCHAR AS id, arg_max('x' || p, pos) AS e FROM u GROUP BY 1)
SELECT c.id, CASE WHEN w.id IS NULL THEN c.verdict ELSE 'needs_review' END AS verdict, CASE WHEN w.id IS NULL THEN '' ELSE w.e END AS explanation FROM c LEFT JOIN w USING (id)
""")
def batch_updates(spark, d):
    """Updates with single ids and lists of ids; of several for one candidate the last counts."""
    each = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    key = F.col("l_orderkey")
    u = each.select(
        (key * 10 + F.col("l_linenumber")).alias("pos"), key.cast("string").alias("candidate_id"), F.array((key + 1).cast("string")).alias("candidate_ids"),
        F.lit("needs_review").alias("verdict"), F.concat(F.lit("x"), F.col("p").cast("string")).alias("explanation"),
    )
    return M.merge_verdicts(_candidates(spark, d).withColumn("explanation", F.lit("")), M.expand_updates(u)).select("id", "verdict", "explanation")


_PART_TASKS = "SELECT 'task-' || p_partkey AS id, p_partkey, p_name, p_brand, p_type FROM part"


@query(f"""
SELECT id, CASE WHEN p_partkey % 3 = 0 THEN p_type || ' of the ' || p_brand || ' kind' WHEN p_partkey % 3 = 1 THEN p_type
  WHEN len(regexp_extract_all(p_name, '\\b\\w{{4,}}\\b')) > 0 THEN array_to_string(regexp_extract_all(p_name, '\\b\\w{{4,}}\\b')[1:3], ' ') ELSE p_name END AS intent, p_partkey % 3 <> 0 AS needs FROM ({_PART_TASKS})
""")
def task_intents(spark, d):
    """Intents merged into tasks, keywords of the name without any, and which tasks still need sentences."""
    part = table(spark, d, "part")
    key = F.concat(F.lit("task-"), F.col("p_partkey").cast("string")).alias("id")
    tasks = part.select(key, F.col("p_partkey").alias("cwe_id"), F.col("p_name").alias("cwe_name"), F.lit("").alias("description"), F.array().cast("array<string>").alias("query_intents"))
    sentence = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(" of the "), "p_brand", F.lit(" kind"))).otherwise(F.col("p_type"))
    merged = audit.merge_intents(tasks, part.where("p_partkey % 3 <> 2").select(key, F.array(sentence).alias("query_intents")))
    needed = audit.tasks_needing_intents(merged).select("id", F.lit(True).alias("__needs"))
    return merged.join(needed, "id", "left").select("id", F.get("query_intents", F.lit(0)).alias("intent"), F.coalesce("__needs", F.lit(False)).alias("needs"))


@query("""
WITH c AS (SELECT o_orderkey::VARCHAR AS id, o_custkey % 25 AS a, o_orderkey % 25 AS b FROM orders)
SELECT c.id, CASE WHEN a = b THEN x.n_name ELSE x.n_name || '|' || y.n_name END AS weaknesses,
  array_to_string(list_filter(list_distinct([CASE WHEN a % 2 = 0 THEN 'ask ' || x.n_regionkey ELSE '' END]) || CASE WHEN (CASE WHEN b % 2 = 0 THEN 'ask ' || y.n_regionkey ELSE '' END) = (CASE WHEN a % 2 = 0 THEN 'ask ' || x.n_regionkey ELSE '' END) THEN [] ELSE [CASE WHEN b % 2 = 0 THEN 'ask ' || y.n_regionkey ELSE '' END] END, lambda t: t <> ''), chr(10)) AS prompt
FROM c JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b
""")
def review_packages(spark, d):
    """Names and prompts of each candidate's classes, in order, each once."""
    orders, text = table(spark, d, "orders"), F.lit("").alias
    c = orders.select(
        F.col("o_orderkey").cast("string").alias("id"), text("file"), text("function"), text("cwe_id"), F.array((F.col("o_custkey") % 25).cast("string"), (F.col("o_orderkey") % 25).cast("string")).alias("matched_cwes"), text("code"), text("context"),
    )
    prompt = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("ask "), F.col("n_regionkey").cast("string"))).otherwise("")
    tasks = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("cwe_id"), F.col("n_name").alias("cwe_name"), prompt.alias("vulnerability_prompt"))
    return audit.packages(c, tasks).select("id", F.array_join("weaknesses", "|").alias("weaknesses"), "prompt")


@query("SELECT n_nationkey, 'cand-uniq-' || row_number() OVER (ORDER BY n_name, n_nationkey) AS id FROM nation")
def numbered_ids(spark, d):
    return M.numbered(table(spark, d, "nation"), ["n_name", "n_nationkey"], "cand-uniq-").select("n_nationkey", "id")


_SPLIT = r"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 2))"


@query(f"""
WITH n AS (SELECT p_partkey AS file, name, unnest({_SPLIT.format('name')}) AS word FROM (SELECT p_partkey, replace(p_name, ' ', '_') || 'Of' || p_type AS name FROM part)),
i AS (SELECT p_partkey AS intent_id, unnest({_SPLIT.format("p_name || ' ' || p_type")}) AS word FROM part WHERE p_partkey % 100 = 0),
s AS (SELECT intent_id, file, name, count(*) AS shared FROM n JOIN i USING (word) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY shared DESC, file, name) AS rank FROM s)
SELECT intent_id, file, name, shared, rank FROM r WHERE rank <= 15
""")
def lexical_match(spark, d):
    """The functions whose names share most words with an intent; intents are the rows whose id is divisible by 100."""
    part = table(spark, d, "part")
    index = part.select(F.col("p_partkey").alias("file"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("Of"), "p_type").alias("name"), F.lit(1).alias("line"))
    intents = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("intent_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return audit.lexical(index, intents).select("intent_id", "file", "name", "shared", "rank")


@query("""
SELECT doc_id, '| ' || source || ' | ' || lang || ' | ' || doc_id || ' | `' || replace(CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END, '|', chr(92) || '|') || '` |' AS entry
FROM (SELECT doc_id, source, lang, replace(text, chr(10), '|') AS t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)
""")
def gap_rows(spark, d):
    """Rows of the coverage table, previews cut to eighty characters and bars escaped."""
    docs = table(spark, d, "documents").where("text is not null and lang is not null and source is not null")
    text = F.translate("text", "\n", "|")
    gaps = docs.select(F.col("source").alias("file"), F.col("lang").alias("function"), F.col("doc_id").alias("line"), text.alias("content"))
    return report.gap_lines(gaps).select(F.col("line").alias("doc_id"), F.col("row").alias("entry"))
