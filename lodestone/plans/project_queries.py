"""Queries with SQL twins over a whole project: ranked lookups, call chains, types, stored plans and indexes.

Line items stand for the lines of a project's files (one file an order), parts for its symbols,
orders for candidates. Every query goes through the library's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import scalars as S
from lodestone.operators import lexical as X
from lodestone.operators import lines as L
from lodestone.operators import merging as M
from lodestone.operators import retrieval as R
from lodestone.operators.numbering import running_numbers
from lodestone.plans import audit, report
from lodestone.plans.catalog import query, quoted, table
from lodestone.sources import catalog_xml, stores
from lodestone.sources.scratch import fresh_folder, written

_FUNCTIONS, _TYPES = 400, 40


def _lines(spark, d) -> DataFrame:
    """``file, line_no, line``: headers, calls, types and mentions of four hundred functions."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    each = L.by_file(items, "l_orderkey", items.count()).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    name = lambda c, n: (F.col(c) % n).cast("string")
    forms = {
        1: ("def fn_", name("p", _FUNCTIONS), "(a):"), 2: ("    row = fn_", name("s", _FUNCTIONS), "(b)"), 3: ("    use(Type_", name("p", _TYPES), ")"),
        4: ("class Type_", name("s", _TYPES), ":"), 5: ("def fn_", name("p", _FUNCTIONS), "(c):"), 6: ("    row = fn_", name("s", _FUNCTIONS), "(d)"),
    }
    line = F.concat(F.lit("    return fn_"), name("p", _FUNCTIONS))
    for k, (a, b, c) in forms.items():
        line = F.when(F.col("l_linenumber") == k, F.concat(F.lit(a), b, F.lit(c))).otherwise(line)
    return each.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), line.alias("line"))


_LINES = f"""
c AS (SELECT l_orderkey AS file, l_linenumber::BIGINT AS line_no, CASE l_linenumber
  WHEN 1 THEN 'def fn_' || (min(l_partkey) % {_FUNCTIONS}) || '(a):' WHEN 2 THEN '    row = fn_' || (min(l_suppkey) % {_FUNCTIONS}) || '(b)' WHEN 3 THEN '    use(Type_' || (min(l_partkey) % {_TYPES}) || ')'
  WHEN 4 THEN 'class Type_' || (min(l_suppkey) % {_TYPES}) || ':' WHEN 5 THEN 'def fn_' || (min(l_partkey) % {_FUNCTIONS}) || '(c):' WHEN 6 THEN '    row = fn_' || (min(l_suppkey) % {_FUNCTIONS}) || '(d)'
  ELSE '    return fn_' || (min(l_partkey) % {_FUNCTIONS}) END AS line FROM lineitem GROUP BY l_orderkey, l_linenumber),
h AS (SELECT file, line_no, regexp_extract(line, '^def (\\w+)', 1) AS name FROM c WHERE starts_with(line, 'def '))"""

# callers by call edges, else by mentions, whose owner is the nearest header above of another name
_CALLERS = f"""
{_LINES},
e AS (SELECT c.file, c.line_no, c.line, h.name AS owner FROM c ASOF JOIN h ON c.file = h.file AND c.line_no >= h.line_no),
x AS (SELECT file, line_no, owner AS src, unnest(list_distinct(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS dst FROM e),
g AS (SELECT src, dst, file, min(line_no) AS line FROM x WHERE src <> dst AND dst IN (SELECT name FROM h) GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT 'fn_' || (o_custkey % {_FUNCTIONS}) AS name FROM orders),
b AS (SELECT name AS dst FROM a WHERE name NOT IN (SELECT dst FROM g)),
w AS (SELECT file, line_no, CASE WHEN starts_with(line, 'def ') THEN regexp_extract(line, '^def (\\w+)', 1) ELSE '' END AS own, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))) AS dst FROM c),
m AS (SELECT w.* FROM w JOIN b USING (dst) WHERE own = '' OR NOT contains(dst, own)),
u AS (SELECT m.file, m.line_no, m.dst, arg_max(h.name, h.line_no) AS src FROM m LEFT JOIN h ON h.file = m.file AND h.line_no <= m.line_no AND h.name <> m.dst GROUP BY 1, 2, 3),
f AS (SELECT coalesce(src, '[module-level] ' || file || ':' || line_no) AS src, dst, file, min(line_no) AS line FROM u GROUP BY 1, 2, 3),
k AS (SELECT src, dst, file, line, false AS is_fallback FROM g WHERE dst IN (SELECT name FROM a) UNION ALL SELECT src, dst, file, line, true FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY file, line, src) AS rank FROM k)"""


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("fn_"), (F.col("o_custkey") % _FUNCTIONS).cast("string")).alias("function")).distinct()


@query(f"WITH {_CALLERS} SELECT src, dst, file, line, is_fallback, rank FROM r WHERE rank <= 10")
def project_callers(spark, d):
    """Callers of the functions that candidates name; a use within the function itself counts for the header above it."""
    lines = _lines(spark, d)
    out = audit.callers_of(_asked(spark, d).withColumnRenamed("function", "dst"), audit.call_edges(lines, L.symbols_of(lines)), lines)
    return out.select("src", "dst", "file", "line", "is_fallback", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_LINES}, w AS (SELECT file, line_no, unnest(list_distinct(regexp_extract_all(line, 'fn_[0-9]+'))) AS dst FROM c),
o AS (SELECT w.file, w.line_no, w.dst, arg_max(h.name, h.line_no) AS name FROM w LEFT JOIN h ON h.file = w.file AND h.line_no <= w.line_no AND h.name <> w.dst GROUP BY 1, 2, 3)
SELECT file, line_no, dst, coalesce(name, '[module-level] ' || file || ':' || line_no) AS enclosing FROM o
""")
def enclosing_of_another_name(spark, d):
    """Each mention of a function with the nearest header at or above it that has another name."""
    lines = _lines(spark, d)
    words = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("fn_[0-9]+"), 0)))
    return L.headed(lines.select("file", "line_no", words.alias("dst")), L.headers_of(lines), avoid="dst")


_NL = "chr(10)"
_HEAD, _TAIL = (t.replace("'", "''").split("{}") for t in (K.CONTEXT_CALLERS, K.CONTEXT_CALLEES))


@query(f"""
WITH {_CALLERS},
s AS (SELECT file, name, min(line_no) AS line FROM h GROUP BY 1, 2),
z AS (SELECT c.file, s.name, c.line_no, c.line FROM c ASOF JOIN s ON c.file = s.file AND c.line_no >= s.line),
p AS (SELECT file, name AS src, trim(string_agg(line, {_NL} ORDER BY line_no), ' ' || chr(9) || chr(13) || {_NL}) AS preview FROM z GROUP BY 1, 2),
t AS (SELECT dst, rank, '- ' || src || ' (' || file || ')' || CASE WHEN rank <= 3 AND preview <> '' THEN ':' || {_NL} || '```' || {_NL} || preview || {_NL} || '```' ELSE '' END AS text, src FROM r LEFT JOIN p USING (file, src) WHERE rank <= 10),
up AS (SELECT dst AS name, string_agg(text, {_NL} ORDER BY rank) AS up, arg_min(src, rank) AS first_caller FROM t GROUP BY 1),
y AS (SELECT src, dst, file, line, row_number() OVER (PARTITION BY src, dst ORDER BY file, line) AS k FROM g),
q AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY file, line, dst) AS rank FROM y WHERE k = 1),
n AS (SELECT name AS dst, arg_min(file, file * 10 + line) AS home FROM s GROUP BY 1),
dn AS (SELECT src AS name, string_agg(dst || ' (' || home || ')', ', ' ORDER BY rank) AS down FROM q JOIN n USING (dst) WHERE rank <= 10 GROUP BY 1),
v AS (SELECT a.name, first_caller, concat('{K.CONTEXT_TITLE}', {_NL}, '{_HEAD[0]}', a.name, '{_HEAD[1]}', {_NL}, coalesce(up, '{K.CONTEXT_NO_CALLERS}'), {_NL}, {_NL},
  '{_TAIL[0]}', a.name, '{_TAIL[1]}', {_NL}, '  ', coalesce(down, '{K.CONTEXT_NO_CALLEES}')) AS text FROM a LEFT JOIN up USING (name) LEFT JOIN dn USING (name))
SELECT name AS function, first_caller, CASE WHEN length(text) > {K.CONTEXT_CHARS} THEN substr(text, 1, {K.CONTEXT_CHARS}) || {_NL} || '... (truncated)' ELSE text END AS context FROM v
""")
def call_contexts(spark, d):
    """The call chain text of each function that candidates name: callers, the first three with their source, and callees with their files."""
    lines = _lines(spark, d)
    symbols = L.symbols_of(lines)
    return audit.contexts(_asked(spark, d), audit.call_edges(lines, symbols), L.first_symbols(symbols, [F.col("line")]), lines).select("function", "first_caller", "context")


@query(f"""
WITH {_LINES}, k AS (SELECT file, line_no, regexp_extract(line, '^class (\\w+)', 1) AS type FROM c WHERE starts_with(line, 'class ')),
f AS (SELECT type, file, line_no FROM k QUALIFY row_number() OVER (PARTITION BY type ORDER BY file, line_no) = 1),
n AS (SELECT f.*, coalesce((SELECT min(k.line_no) FROM k WHERE k.file = f.file AND k.line_no > f.line_no), 1000) AS stop FROM f),
s AS (SELECT n.type, '// Definition for class ' || n.type || chr(10) || string_agg(c.line, chr(10) ORDER BY c.line_no) AS definition FROM n JOIN c ON c.file = n.file AND c.line_no >= n.line_no AND c.line_no < n.stop GROUP BY 1),
w AS (SELECT DISTINCT o_orderkey AS id, unnest(['Type_' || (o_custkey % {_TYPES}), 'Type_' || (o_orderkey % 7)]) AS type FROM orders)
SELECT id, string_agg(definition, chr(10) || chr(10) ORDER BY type) AS struct_definitions FROM w JOIN s USING (type) GROUP BY 1
""")
def wanted_types(spark, d):
    """The definitions of the types that each candidate's snippet names, each with its whole source."""
    orders = table(spark, d, "orders")
    snippet = F.concat(F.lit("x = Type_"), (F.col("o_custkey") % _TYPES).cast("string"), F.lit("(Type_"), (F.col("o_orderkey") % 7).cast("string"), F.lit(")"))
    return audit.definitions(orders.select(F.col("o_orderkey").alias("id"), snippet.alias("code")), _lines(spark, d), "python")


_STEMS = ["findBy", "get_by_id", "loadUser", "open", "fetch_by", "queryOne", "objects", "find_one", "Where", "user_id"]
_SIGNALS = [s for s in dict.fromkeys([*K.COMMON_SIGNALS, *(s for v in K.LANGUAGES.values() for s in v[3])]) if not ("." in s or "\\" in s)]
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1))"


@query(f"""
WITH s AS (SELECT p_partkey AS file, [{quoted(_STEMS)}][p_partkey % {len(_STEMS)} + 1] || '_' || replace(p_name, ' ', '_') AS name FROM part),
q AS (SELECT i - 1 AS query_id, [{quoted(_SIGNALS)}][i] AS text FROM range(1, {len(_SIGNALS) + 1}) t(i) UNION ALL SELECT 1000 + p_partkey, p_name FROM part WHERE p_partkey % 100 = 0),
p AS (SELECT file, name, len(w) AS n_words, unnest(w) AS word FROM (SELECT file, name, {_WORDS.format('name')} AS w FROM s)),
t AS (SELECT query_id, lower(text) AS text, unnest({_WORDS.format('text')}) AS word FROM q),
f AS (SELECT word, ln(1 + ((SELECT count(*) FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM p GROUP BY 1),
h AS (SELECT query_id, file, name, lower(name) = text AS same, round(sum(weight) / sqrt(n_words), 9) AS score FROM p JOIN t USING (word) JOIN f USING (word) GROUP BY query_id, text, file, name, n_words),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, score DESC, file, name) AS rank FROM h)
SELECT query_id, file, name, score, rank FROM r WHERE rank <= {K.LEXICAL_LIMIT}
""")
def lexical_signals(spark, d):
    """The best symbols for each resource signal, and for the intents that rows with an id divisible by 100 stand for."""
    part = table(spark, d, "part")
    stem = F.element_at(F.array(*map(F.lit, _STEMS)), (F.col("p_partkey") % len(_STEMS) + 1).cast("int"))
    symbols = part.select(F.col("p_partkey").alias("file"), F.concat(stem, F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.lit(1).alias("line"))
    asked = spark.createDataFrame(list(enumerate(_SIGNALS)), "query_id long, text string")
    asked = asked.unionByName(part.where("p_partkey % 100 = 0").select((F.col("p_partkey") + 1000).alias("query_id"), F.col("p_name").alias("text")))
    return X.lookup(symbols, asked).select("query_id", "file", "name", "score", "rank")


_HEADERS = ["func (s *Box) {}(a int)", "func {}()", "function {}(a, b) {{", "const {} = async (a) => a", "let {} = x => x", "static int * {} (void)", "unsigned long {}(int a)", "return {}(a)", "  def {}(self):", "x = {}(a)", "if ({}(a))"]
_NAMED = [True, True, True, True, True, True, True, False, True, False, False]


@query(f"""
SELECT p_partkey AS file, 'fn' || p_partkey AS name, p_size::INT AS line FROM part WHERE [{', '.join(str(x).lower() for x in _NAMED)}][p_partkey % {len(_HEADERS)} + 1]
""")
def header_forms(spark, d):
    """Symbols by the header forms of Go, JavaScript, C and Python; statements that look like one are none."""
    key = F.col("p_partkey")
    line = F.lit("")
    for i, form in enumerate(_HEADERS):
        a, b = form.replace("{{", "{").split("{}")
        line = F.when(key % len(_HEADERS) == i, F.concat(F.lit(a), F.lit("fn"), key.cast("string"), F.lit(b))).otherwise(line)
    return L.symbols_of(table(spark, d, "part").select(key.alias("file"), F.col("p_size").alias("line_no"), line.alias("line")))


@query("SELECT p_partkey AS file, p_name AS name, p_size::INT AS line FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 5 <> 0")
def coverage_listing(spark, d):
    """Functions and methods of listing rows as coverage reads them: rows without a number are left out."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["function", "method", "class"])), (key % 3 + 1).cast("int"))
    row = F.concat(F.lit("- `"), "p_name", F.lit("` ("), kind, F.lit(") — :"), F.when(key % 5 == 0, "").otherwise(F.col("p_size").cast("string")))
    return L.parse_symbol_listing(table(spark, d, "part").select(key.alias("file"), row.alias("row")), numbered=True)


# --- stored plans, packages and indexes ------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem")
def running_ids(spark, d):
    """A running number for every line item, in order."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return running_numbers(table(spark, d, "lineitem").select(*order), order, "n")


@query("""
WITH k AS (SELECT *, p_partkey // 2 AS id, p_partkey % 11 = 0 AS broken FROM part),
w AS (SELECT * FROM k WHERE NOT broken QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_partkey DESC) = 1)
SELECT id::VARCHAR AS id, 'scope' AS part, 0::BIGINT AS pos, p_brand AS text FROM w
UNION ALL SELECT id::VARCHAR, 'scope', 1, '' FROM w
UNION ALL SELECT id::VARCHAR, 'scope', 2, p_type || ' & &lt;b>' FROM w WHERE p_partkey % 3 = 0
UNION ALL SELECT id::VARCHAR, 'example', 0, 'Python: x < ' || p_size || ' "' || p_name || '"' FROM w WHERE p_partkey % 4 <> 1
UNION ALL SELECT id::VARCHAR, 'mitigation', 0, CASE WHEN p_partkey % 2 = 0 THEN 'Design' ELSE 'Build' END || ': ' || p_type FROM w WHERE p_partkey % 5 <> 0
""")
def catalog_from_xml(spark, d):
    """Scopes, bad examples and mitigations of weaknesses read from XML; of two with one id the later counts, broken ones don't."""
    key = F.col("p_partkey")
    opt = lambda when, *parts: F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(F.lit(""))
    always = F.lit(True)
    xml = F.concat(
        opt(always, '<Weakness ID="', F.floor(key / 2).cast("string"), '" Name="n" Status="Draft"><Description>about <i>', F.col("p_brand"), "</i></Description>"),
        opt(always, "<Common_Consequences><Consequence><Scope>", F.col("p_brand"), "</Scope></Consequence><Consequence><Scope> </Scope>"), opt(key % 3 == 0, "<Scope>", F.col("p_type"), " &amp; &amp;lt;b&gt;</Scope>"),
        opt(always, "<Impact>i</Impact></Consequence></Common_Consequences><Demonstrative_Examples><Demonstrative_Example><Intro_Text>t</Intro_Text>"),
        opt(always, '<Example_Code Nature="', F.when(key % 4 == 1, "Good").otherwise("Bad"), '" Language="Python">x &lt; ', F.col("p_size").cast("string"), ' "<b>', F.col("p_name"), '</b>"</Example_Code>'),
        opt(always, "</Demonstrative_Example></Demonstrative_Examples><Potential_Mitigations><Mitigation>"), opt(key % 2 == 0, "<Phase>Design</Phase>"), opt(always, "<Phase>Build</Phase><Description>"),
        opt(key % 5 != 0, F.col("p_type")), opt(always, "</Description></Mitigation></Potential_Mitigations>"), opt(key % 11 != 0, "</Weakness>"),
    )
    part = table(spark, d, "part")
    part = L.by_file(part, "p_partkey", part.count(), 100_000)  # a small file has many elements, which one task would parse
    return catalog_xml.catalog_details(catalog_xml.parse_catalog(part.select(xml.alias("xml"), key.alias("ord"))))


def _package_lines(spark, d) -> DataFrame:
    """Packages as JSON lines, every seventh cut in half and every eleventh without its file."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        key.alias("o"), key.cast("string").alias("id"), F.when(key % 11 != 0, F.concat(F.lit('src\\"a"/'), F.col("o_custkey").cast("string"))).alias("file"), F.col("o_orderpriority").alias("function"),
        (key % 9).cast("string").alias("cwe_id"), F.array((key % 9).cast("string"), F.lit("Ünï|")).alias("matched_cwes"), F.array().cast("array<string>").alias("weaknesses"),
        F.lit(None).cast("string").alias("prompt"), F.concat(F.lit("if x:\n\t"), "o_orderstatus").alias("code"), F.lit("").alias("context"),
    )
    lines = stores.to_json_lines(rows, ["o"])
    cut = F.substring("value", F.lit(1), F.floor(F.length("value") / 2).cast("int"))
    return lines.select("o", F.when(F.col("o") % 7 == 0, cut).otherwise(F.col("value")).alias("value"))


@query("""
SELECT o_orderkey AS o, o_orderkey::VARCHAR AS id, 'src\\"a"/' || o_custkey AS file, o_orderpriority AS function, (o_orderkey % 9)::VARCHAR AS cwe_id, (o_orderkey % 9) || '|Ünï|' AS matched, 0 AS n_weaknesses,
  true AS no_prompt, 'if x:' || chr(10) || chr(9) || o_orderstatus AS code, '' AS context FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0
""")
def package_round_trip(spark, d):
    """Packages written as JSON lines and read back; broken lines and those without a file are left out."""
    rows = stores.from_json_lines(_package_lines(spark, d), stores.PACKAGE, "file")[0]
    return rows.select("o", "id", "file", "function", "cwe_id", F.array_join("matched_cwes", "|").alias("matched"), F.size("weaknesses").alias("n_weaknesses"), F.col("prompt").isNull().alias("no_prompt"), "code", "context")


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'broken' ELSE 'incomplete' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 GROUP BY 1")
def package_losses(spark, d):
    """How many lines of packages are left out, and why."""
    return stores.from_json_lines(_package_lines(spark, d), stores.PACKAGE, "file")[1]


@query("""
WITH o AS (SELECT doc_id::VARCHAR AS path, md5(text) AS md5 FROM documents),
n AS (SELECT (CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END)::VARCHAR AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END) AS md5 FROM documents)
SELECT n.path, n.md5, CASE WHEN o.md5 = n.md5 THEN 1 ELSE 2 END AS written FROM n LEFT JOIN o USING (path)
""")
def incremental_index(spark, d):
    """An index in buckets after two snapshots of the documents, each row with the snapshot that wrote it: rows of unchanged
    files stay, those of edited, new and deleted ones are replaced bucket by bucket."""
    docs = table(spark, d, "documents")
    later = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    first = docs.select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("md5"))
    second = docs.select(moved.cast("string").alias("path"), F.md5(later).alias("md5"))
    store = stores.SnapshotStore(spark, fresh_folder(spark, "snapshots"))
    index = store.bucketed("index", "path", 16)
    for number, now in enumerate((first, second), 1):
        old = store.read("index") if store.exists("index") else first.limit(0)
        changed = store.write("states", R.compare_snapshots(old.select("path", "md5"), now)).where("state <> 'unchanged'").select("path")
        index.replace(changed, now.join(changed, "path", "left_semi").withColumn("written", F.lit(number)))
    return store.read("index")


@query("""
WITH ev AS (
  SELECT l_suppkey % 50 AS task, l_partkey AS name, CASE WHEN l_returnflag = 'R' THEN 'resource' WHEN l_returnflag = 'A' THEN 'symbol' ELSE 'vector' END AS road, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
f AS (SELECT task, name, arg_min(road, ord) AS road FROM ev GROUP BY 1, 2)
SELECT r.road, (SELECT count(*) FROM f WHERE f.road = r.road) AS added, (SELECT count(*) FROM f) AS total FROM (VALUES ('vector'), ('symbol'), ('resource')) r(road)
""")
def road_tally(spark, d):
    """How many candidates each road added, observed while the roads are merged."""
    flag = F.col("l_returnflag")
    events = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("task"), F.col("l_partkey").alias("name"), F.when(flag == "R", "resource").when(flag == "A", "symbol").otherwise("vector").alias("road"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("recall_ord"),
    )
    seen = Observation()
    written(M.recall_union(events, ["task", "name"], observation=seen), "merged")
    tally = seen.get
    return spark.createDataFrame([(road, tally[road], tally["total"]) for road in M.ROADS], "road string, added long, total long")


# --- quotas, single verdicts and reports -----------------------------------------------------------

_NAMES_ASKED = 197


@query(f"""
WITH RECURSIVE e AS (
  SELECT l_suppkey AS task_id, l_linenumber AS signal_ord, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS phase, l_orderkey * 10 + l_linenumber AS ord, l_partkey % {_NAMES_ASKED} AS name, l_orderkey % 5 AS file FROM lineitem),
t AS (SELECT * FROM e WHERE phase = 0 UNION ALL SELECT task_id, signal_ord, phase, min(ord), name, file FROM e WHERE phase = 1 GROUP BY task_id, signal_ord, phase, name, file),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY signal_ord, phase, ord, name, file) AS i FROM t),
k AS (SELECT l_suppkey AS task_id, list(DISTINCT l_partkey % {_NAMES_ASKED}) AS known FROM lineitem WHERE l_discount > 0.08 GROUP BY 1),
s AS (
  SELECT task_id, 0::BIGINT AS i, 0 AS added, 0 AS room, -1::BIGINT AS open, coalesce(known, []) AS names, false AS fresh FROM (SELECT DISTINCT task_id FROM e) LEFT JOIN k USING (task_id)
  UNION ALL
  SELECT task_id, i, added + (look AND other)::INT, room - phase, CASE WHEN phase = 1 THEN signal_ord ELSE open END, CASE WHEN look AND other THEN list_append(names, name) ELSE names END, look AND other
  FROM (SELECT *, CASE WHEN phase = 1 THEN room > 0 ELSE added < {K.RESOURCE_LIMIT} END AS look
    FROM (SELECT n.task_id, n.i, n.phase, n.signal_ord, n.name, s.added, s.open, s.names, NOT list_contains(s.names, n.name) AS other,
        CASE WHEN n.phase = 1 AND s.open <> n.signal_ord THEN {K.RESOURCE_LIMIT} - s.added ELSE s.room END AS room
      FROM s JOIN n ON n.task_id = s.task_id AND n.i = s.i + 1)))
SELECT n.task_id, n.signal_ord, n.phase, n.ord, n.name, n.file FROM s JOIN n USING (task_id, i) WHERE fresh
""")
def quota_names(spark, d):
    """Names that resource signals add to each task: known ones are free, usages are cut to what the quota has left."""
    lines = table(spark, d, "lineitem").withColumn("name", F.col("l_partkey") % _NAMES_ASKED)
    task = F.col("l_suppkey").alias("task_id")
    events = lines.select(
        task, F.col("l_linenumber").alias("signal_ord"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("phase"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "name", (F.col("l_orderkey") % 5).alias("file"),
    )
    return R.resource_quota(events, lines.where("l_discount > 0.08").select(task, "name"))


_JUDGED = """SELECT o_orderkey AS id, o_orderkey AS ord, 'src/' || o_custkey AS file, o_orderpriority AS function, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 5)::VARCHAR END AS cwe_id,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS cwe_name, CASE o_custkey % 3 WHEN 0 THEN [o_orderstatus, o_orderpriority] WHEN 1 THEN [o_orderstatus] ELSE [] END AS matched_cwes,
  ['verified', 'needs_review', 'false_positive', 'pending'][o_orderkey % 4 + 1] AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN 'caller' || o_custkey ELSE '' END AS entrypoint,
  CASE WHEN o_orderkey % 5 > 0 THEN 'as ' || o_orderpriority END AS explanation, CASE WHEN o_custkey % 2 = 0 THEN 'class T' || o_custkey END AS struct_definitions FROM orders"""


def _judged(spark, d) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = customer.cast("string")
    classes = F.when(customer % 3 == 0, F.array("o_orderstatus", "o_orderpriority")).when(customer % 3 == 1, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>"))
    verdict = F.element_at(F.array(*map(F.lit, ["verified", "needs_review", "false_positive", "pending"])), (key % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        key.cast("string").alias("id"), key.alias("ord"), F.concat(F.lit("src/"), text).alias("file"), F.col("o_orderpriority").alias("function"), F.when(key % 7 != 0, (key % 5).cast("string")).alias("cwe_id"),
        F.when(key % 2 == 0, F.col("o_orderstatus")).alias("cwe_name"), classes.alias("matched_cwes"), verdict.alias("verdict"), F.when(key % 3 == 0, F.concat(F.lit("caller"), text)).otherwise("").alias("entrypoint"),
        F.when(key % 5 > 0, F.concat(F.lit("as "), "o_orderpriority")).alias("explanation"), F.when(customer % 2 == 0, F.concat(F.lit("class T"), text)).alias("struct_definitions"),
    )


@query(f"""
WITH c AS ({_JUDGED}), m AS (SELECT max(id) AS id FROM c WHERE verdict = 'pending')
SELECT c.id::VARCHAR AS id, CASE WHEN m.id IS NULL THEN verdict ELSE 'verified' END AS verdict, CASE WHEN m.id IS NULL THEN explanation ELSE 'seen' END AS explanation,
  CASE WHEN m.id IS NULL THEN entrypoint ELSE 'main' END AS entrypoint, function FROM c LEFT JOIN m ON c.id = m.id
""")
def single_update(spark, d):
    """All candidates after one verdict, for the pending one of the largest id; what is not given stays."""
    judged = _judged(spark, d)
    last = judged.where("verdict = 'pending'").agg(F.max("ord")).first()[0]  # one value
    if last is not None:
        judged = M.merge_verdict(judged, str(last), "verified", "seen", entrypoint="main", function=None)
    return judged.select("id", "verdict", "explanation", "entrypoint", "function")


@query(f"""
WITH c AS ({_JUDGED}),
v AS (SELECT l_orderkey AS id, string_agg(DISTINCT nullif(CASE WHEN l_linenumber = 1 THEN 'None' ELSE 'by ' || l_returnflag END, 'None'), '; ' ORDER BY nullif(CASE WHEN l_linenumber = 1 THEN 'None' ELSE 'by ' || l_returnflag END, 'None')) AS path,
  string_agg(DISTINCT CASE WHEN l_tax > 0.04 THEN 'no ' || l_linestatus END, '; ' ORDER BY CASE WHEN l_tax > 0.04 THEN 'no ' || l_linestatus END) AS missing FROM lineitem GROUP BY 1)
SELECT verdict AS bucket, ord, '### `' || function || '` (' || CASE len(matched_cwes) WHEN 2 THEN 'CWE-' || matched_cwes[1] || ' / CWE-' || matched_cwes[2] WHEN 1 THEN 'CWE-' || matched_cwes[1]
    ELSE 'CWE-' || coalesce(cwe_id, '?') || ': ' || coalesce(cwe_name, '') END || ')' || {_NL} || '- File: file:///work/project/' || file
  || CASE WHEN entrypoint <> '' THEN {_NL} || '- Entry point: ' || entrypoint ELSE '' END || CASE WHEN coalesce(explanation, '') <> '' THEN {_NL} || '- Explanation: ' || explanation ELSE '' END
  || CASE WHEN verdict = 'verified' AND coalesce(path, '') <> '' THEN {_NL} || '- Attack path: ' || path ELSE '' END || CASE WHEN verdict = 'verified' AND struct_definitions IS NOT NULL THEN {_NL} || '- Types: ' || struct_definitions ELSE '' END
  || CASE WHEN verdict = 'needs_review' AND coalesce(missing, '') <> '' THEN {_NL} || '- Missing evidence: ' || missing ELSE '' END AS text
FROM c LEFT JOIN v USING (id) WHERE verdict <> 'pending'
""")
def report_entries(spark, d):
    """The report's entry of every judged candidate; attack paths of verified ones, missing evidence of those to review."""
    votes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("candidate_id"), F.when(F.col("l_linenumber") == 1, "None").otherwise(F.concat(F.lit("by "), "l_returnflag")).alias("attack_path"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("no "), "l_linestatus")).alias("missing"),
    )
    return report.report_lines(_judged(spark, d), votes, "/work/project")
