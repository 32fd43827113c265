"""Registry of the engine's queries over the provided tables, with their SQL twins.

The audit's own inputs are stood in for by tables of the same shape (SURVEY 7.4): documents and
pages for files, their lines for source lines, embeddings for the vector index, lineitem and orders
for votes and candidates, conversations for call neighbours, events for as-of lookups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import scalars as S
from lodestone.operators import lines as L
from lodestone.operators import merging as M
from lodestone.operators import retrieval as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with ``__place``: file and row of each row, which orders what else is tied as a scan in order does."""
    return table(spark, sf_dir, name).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("__place"))


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _lines(spark, d) -> DataFrame:
    return L.explode_lines(table(spark, d, "documents").where("text is not null"), ["doc_id"], "text")


_LINES = "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL"
_HEAD_WORDS = ["The", "Of", "And", "In", "Is", "For"]
_SINK = r"(thing|ation)"


@query(f"""
WITH l AS ({_LINES}),
s AS (SELECT doc_id, line_no, regexp_extract(line, '^({'|'.join(_HEAD_WORDS)}) ', 1) AS name FROM l WHERE regexp_matches(line, '^({'|'.join(_HEAD_WORDS)}) ')),
h AS (SELECT * FROM l WHERE regexp_matches(line, '{_SINK}')),
o AS (SELECT h.doc_id, h.line_no, h.line, s.name AS function FROM h ASOF JOIN s ON h.doc_id = s.doc_id AND h.line_no >= s.line_no)
SELECT doc_id, line_no, function, CASE WHEN length(line) > 80 THEN substr(line, 1, 77) || '...' ELSE line END AS content
FROM o WHERE NOT EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = o.doc_id AND b.quality = 1)
ORDER BY 1, 2
""")
def coverage_gaps(spark, d):
    """Marked lines whose owning header is not in a recalled document."""
    lines = _lines(spark, d)
    head = F.regexp_extract("line", f"^({'|'.join(_HEAD_WORDS)}) ", 1)
    symbols = lines.select("doc_id", head.alias("name"), F.col("line_no").alias("line"), F.col("line_no").alias("listing_ord")).where("name <> ''")
    hits = lines.where(F.col("line").rlike(_SINK)).select("doc_id", "line_no", "line")
    owned = L.owning_symbol(hits, symbols, "doc_id")
    recalled = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    gaps = owned.join(recalled, "doc_id", "left_anti")
    return gaps.select("doc_id", "line_no", "function", S.preview(F.col("line")).alias("content")).orderBy("doc_id", "line_no")


@query(f"SELECT doc_id, line_no, length(line)::BIGINT AS n_chars FROM ({_LINES})")
def line_explode(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", F.length("line").cast("long").alias("n_chars"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, lang LIMIT 1")
def ext_lang_argmax(spark, d):
    n = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "lang").limit(1)


_SEGMENTS = "string_split(lower(replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), chr(92), '/')), '/')"


def _url_path() -> Column:
    return F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")


_URL_BLACKLIST = ["fr", "de", *K.INDEX_BLACKLIST]


@query(f"SELECT page_id, url FROM pages WHERE NOT list_has_any({_SEGMENTS}, [{quoted(_URL_BLACKLIST)}])")
def path_blacklist_filter(spark, d):
    return table(spark, d, "pages").where(~S.has_segment(_url_path(), _URL_BLACKLIST)).select("page_id", "url")


@query(f"""
SELECT CASE WHEN list_has_any({_SEGMENTS}, [{quoted(K.REACH_LOW)}]) THEN 'low' WHEN list_has_any({_SEGMENTS}, [{quoted(K.REACH_HIGH)}]) THEN 'high' ELSE 'medium' END AS reachability,
       regexp_extract(url, '^[a-z]+', 0) AS scheme, count(*) AS n FROM pages GROUP BY 1, 2
""")
def reachability_hint(spark, d):
    hint = S.reachability(_url_path()).alias("reachability")
    return table(spark, d, "pages").groupBy(hint, F.regexp_extract("url", "^[a-z]+", 0).alias("scheme")).agg(F.count("*").alias("n"))


_TAGS = {"license": ["licensed? under", "license"], "contact": [r"@[a-z]+\.", r"\([0-9]{3}\)"], "secret": ["token =", "password"], "never": ["no such words here"]}


@query("\nUNION ALL\n".join(f"SELECT '{t}' AS tag, coalesce(bool_or(regexp_matches(text, '(?i)({'|'.join(p)})')), false) AS found FROM documents" for t, p in _TAGS.items()))
def prescan_tags(spark, d):
    return R.found_tags(table(spark, d, "documents"), {t: (p, []) for t, p in _TAGS.items()}, "text")




@query("""
WITH
rules(tag, id) AS (SELECT p_brand, p_type FROM part WHERE p_size <= 20),
found(tag) AS (SELECT DISTINCT p_brand FROM part WHERE p_size <= 3)
SELECT p_partkey, p_type FROM part p
WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.id = p.p_type) OR EXISTS (SELECT 1 FROM rules r JOIN found f USING (tag) WHERE r.id = p.p_type)
""")
def rule_prune(spark, d):
    """Part types as classes; brands as tags that map the types of their small parts, found by tiny ones."""
    part = table(spark, d, "part")
    mapping = part.where("p_size <= 20").select(F.col("p_brand").alias("tag"), F.col("p_type").alias("id")).distinct()
    found = part.where("p_size <= 3").select(F.col("p_brand").alias("tag"))
    kept = R.prune(part.select("p_partkey", F.col("p_type").alias("id")), mapping, found)
    return kept.select("p_partkey", F.col("id").alias("p_type"))


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang = '' OR lang IN ('en', 'fr')")
def alias_filter(spark, d):
    langs = F.array_remove(F.array_compact(F.array("lang")), "")
    return table(spark, d, "documents").where((F.size(langs) == 0) | F.arrays_overlap(langs, F.array(F.lit("en"), F.lit("fr")))).select("doc_id", "lang")


_SIGNALS = ["is", "was", "from"]
_PROSE_HEAD = r"^([A-Z][a-z]+) (?:[a-z]+ ){2}"


@query(f"""
WITH l AS ({_LINES}),
h AS (SELECT doc_id, line_no, regexp_extract(line, '{_PROSE_HEAD}', 1) AS name FROM l WHERE regexp_matches(line, '{_PROSE_HEAD}')),
u AS (SELECT doc_id, line_no, unnest([{quoted(_SIGNALS)}]) AS signal, line FROM l),
v AS (SELECT doc_id, line_no, signal FROM u WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])' || signal || '([^A-Za-z0-9_]|$)')),
e AS (SELECT v.*, coalesce(h.name, '[module-level] ' || v.doc_id || ':' || v.line_no) AS enclosing FROM v ASOF LEFT JOIN h ON v.doc_id = h.doc_id AND v.line_no >= h.line_no)
SELECT doc_id, signal, enclosing, min(line_no) AS line_no FROM e GROUP BY 1, 2, 3
""")
def signal_usage_enclosing(spark, d):
    """First use of each word in each stretch of a document that a header-like line opens."""
    lines = _lines(spark, d)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("line", _PROSE_HEAD, 1), F.lit(""))
    headed = lines.withColumn("enclosing", F.coalesce(F.last(head, ignorenulls=True).over(w), S.module_label(F.col("doc_id"), F.col("line_no"))))
    hit = F.array_compact(F.array(*(F.when(S.word_bounded(F.col("line"), s), F.lit(s)) for s in _SIGNALS)))
    used = headed.select("doc_id", F.explode(hit).alias("signal"), "enclosing", "line_no")
    return used.groupBy("doc_id", "signal", "enclosing").agg(F.min("line_no").alias("line_no"))


@query(r"""
SELECT doc_id FROM documents WHERE NOT (text IS NULL OR length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) < 30 OR len(string_split(text, chr(10))) < 6)
""")
def snippet_floor(spark, d):
    return table(spark, d, "documents").where(~S.below_snippet_floor(F.col("text"))).select("doc_id")


@query(r"""
SELECT p_partkey, CASE WHEN len(regexp_extract_all(p_name, '\b\w{4,}\b')) > 0 THEN array_to_string(regexp_extract_all(p_name, '\b\w{4,}\b')[1:3], ' ') ELSE p_name END AS keywords FROM part
""")
def keyword_fallback(spark, d):
    return table(spark, d, "part").select("p_partkey", S.keyword_fallback(F.col("p_name")).alias("keywords"))


_WORDS4 = r"len(list_filter(regexp_split_to_array(trim(x), '\s+'), lambda t: t <> '')) >= 4"


@query(f"""
SELECT 'doc' AS kind, doc_id AS id, len(list_filter(string_split(text, chr(10)), lambda x: {_WORDS4})) > 0 AS semantic FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'part', p_partkey, len(list_filter([p_name], lambda x: {_WORDS4})) > 0 FROM part
""")
def semantic_intent(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), S.semantic_intents(F.split("text", "\n", -1)).alias("semantic"))
    parts = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), S.semantic_intents(F.array("p_name")).alias("semantic"))
    return docs.unionByName(parts)


@query("SELECT doc_id, source || chr(10) || array_to_string(string_split(text, chr(10))[1:40], chr(10)) AS embed_text FROM documents")
def embed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.embed_text(F.col("source"), F.col("text")).alias("embed_text"))


@query("""
WITH o AS (SELECT doc_id AS path, md5(text) AS h FROM documents),
n AS (SELECT CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents)
SELECT CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n
FROM o FULL JOIN n ON o.path = n.path GROUP BY 1
""")
def md5_changes(spark, d):
    """How many files of two snapshots of the whole table are in each state; in the later one some ids moved and some texts were edited."""
    docs = table(spark, d, "documents")
    later = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 7 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    new = docs.select(moved.alias("path"), F.md5(later).alias("md5"))
    return R.compare_snapshots(docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("md5")), new).groupBy("state").agg(F.count("*").alias("n"))


_COSINE = """
WITH i AS (SELECT vec_id AS intent_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT i.intent_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) + 1e-9), 6) AS score
      FROM i, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY score DESC, vec_id) AS rank FROM s),
k AS (SELECT CASE WHEN count(*) <= 0 THEN 30 ELSE greatest(5, least(30, round_even(count(*) * 0.05, 0)))::INT END AS k FROM embeddings)
SELECT intent_id, vec_id, score, rank FROM r, k WHERE rank <= k
"""


def _top(spark, d, floor=None) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    k = e.agg(S.adaptive_k(F.count("*"))).first()[0]
    intents = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("intent_id"), F.col("embedding").alias("query"))
    out = R.cosine_top_k(e, intents, k, floor, order=("vec_id",), digits=6)
    return out.select("intent_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(_COSINE)
def cosine_topk(spark, d):
    return _top(spark, d)


@query(_COSINE + " AND score >= 0.3")
def cosine_floor(spark, d):
    return _top(spark, d, 0.3)


@query("""
SELECT label, count(*) AS n, CASE WHEN count(*) <= 0 THEN 30 ELSE greatest(5, least(30, round_even(count(*) * 0.05, 0)))::INT END AS k FROM embeddings GROUP BY 1
UNION ALL SELECT -n, n, greatest(5, least(30, round_even(n * 0.05, 0)))::INT FROM (VALUES (50), (130), (150), (217), (600), (2000)) t(n)
""")
def adaptive_k(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    fixed = spark.createDataFrame([(-x, x) for x in (50, 130, 150, 217, 600, 2000)], "label int, n long")
    return n.unionByName(fixed).withColumn("k", S.adaptive_k(F.col("n")))


@query(f"""
WITH v AS ({_COSINE}),
ev AS (
  SELECT intent_id, vec_id, 'vector' AS road, rank AS ord FROM v
  UNION ALL SELECT q.vec_id, e.vec_id, 'symbol', 1000 + e.vec_id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0
  UNION ALL SELECT q.vec_id, e.vec_id, 'resource', 1000000000 + e.vec_id FROM embeddings q JOIN embeddings e ON e.label = (q.label + 1) % 10 WHERE q.vec_id % 100 = 0),
g AS (SELECT intent_id, vec_id, arg_min(road, ord) AS first, min(ord) AS ord, count(DISTINCT road) AS roads FROM ev GROUP BY 1, 2)
SELECT intent_id, vec_id, ord AS recall_ord, CASE WHEN first <> 'resource' AND roads > 1 THEN 'both' ELSE first END AS recall_source FROM g
""")
def recall_union_source(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("intent_id"), F.col("label").alias("l"))
    vector = _top(spark, d).select("intent_id", "vec_id", F.lit("vector").alias("road"), F.col("rank").alias("recall_ord"))
    symbol = asked.join(e, F.col("l") == F.col("label")).select("intent_id", "vec_id", F.lit("symbol").alias("road"), (F.col("vec_id") + 1000).alias("recall_ord"))
    resource = asked.join(e, (F.col("l") + 1) % 10 == F.col("label")).select("intent_id", "vec_id", F.lit("resource").alias("road"), (F.col("vec_id") + 1000000000).alias("recall_ord"))
    events = vector.unionByName(symbol).unionByName(resource).withColumn("at", F.col("recall_ord"))
    return M.recall_union(events, ["intent_id", "vec_id"]).select("intent_id", "vec_id", F.col("at").alias("recall_ord"), "recall_source")


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS ord, l_linenumber, l_quantity,
  CASE l_returnflag WHEN 'R' THEN 'resource' WHEN 'A' THEN 'symbol' ELSE 'vector' END AS source FROM lineitem),
r AS (SELECT *, CASE source WHEN 'resource' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END AS rank FROM c),
f AS (SELECT l_partkey, l_suppkey, l_linenumber, min(ord) AS ord FROM r GROUP BY 1, 2, 3),
k AS (SELECT l_partkey, l_suppkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY ord) AS matched, arg_min(l_linenumber::VARCHAR, ord) AS cwe_id FROM f GROUP BY 1, 2)
SELECT r.l_partkey, r.l_suppkey, min(ord) AS ord, arg_min(l_quantity, ord) AS quantity, any_value(matched) AS matched, any_value(cwe_id) AS cwe_id, arg_max(source, rank) AS recall_source
FROM r JOIN k USING (l_partkey, l_suppkey) GROUP BY 1, 2
""")
def candidate_dedup(spark, d):
    source = F.when(F.col("l_returnflag") == "R", "resource").when(F.col("l_returnflag") == "A", "symbol").otherwise("vector")
    c = table(spark, d, "lineitem").select(
        "l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_linenumber").cast("string").alias("cwe_id"), F.col("l_quantity").alias("quantity"), source.alias("recall_source")
    )
    out = M.dedup_candidates(c, ["l_partkey", "l_suppkey"], "ord")
    return out.select("l_partkey", "l_suppkey", "ord", "quantity", F.array_join("matched_cwes", ",").alias("matched"), "cwe_id", "recall_source")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def first_n_per_task(spark, d):
    return M.first_n(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5)


_VOTES = "SELECT o_orderkey AS candidate_id, l_returnflag = 'R' AS is_real, l_quantity > 25 AS has_path, l_discount > 0.08 AS has_missing, l_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"""
WITH t AS (SELECT candidate_id, count_if(coalesce(is_real, false)) AS n_true, bool_or(coalesce(is_real AND has_path, false)) AS has_path, bool_or(coalesce(has_missing, false)) AS has_missing FROM ({_VOTES}) GROUP BY 1)
SELECT candidate_id, n_true, has_path, has_missing, CASE WHEN n_true >= 2 AND has_path THEN 'verified' WHEN n_true >= 1 OR has_missing THEN 'needs_review' ELSE 'false_positive' END AS verdict FROM t
""")
def vote_triage(spark, d):
    """Lines as votes on their order; an order without lines has no surviving vote."""
    votes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), (F.col("l_returnflag") == "R").alias("is_real"), (F.col("l_quantity") > 25).alias("has_path"), (F.col("l_discount") > 0.08).alias("has_missing"))
    all_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id")).join(votes, "candidate_id", "left")
    return M.tally_votes(all_)


@query("SELECT d.doc_id, l.quality * 10 - l.toxic * 4 AS severity, CASE WHEN l.quality * 10 - l.toxic * 4 < 5 THEN 'skip' ELSE 'review' END AS gate FROM documents d LEFT JOIN labels l USING (doc_id)")
def severity_gate(spark, d):
    s = table(spark, d, "labels").select("doc_id", (F.col("quality") * 10 - F.col("toxic") * 4).alias("severity"))
    return M.severity_gate(table(spark, d, "documents").select("doc_id").join(s, "doc_id", "left"))


@query("""
WITH u AS (SELECT l_orderkey, arg_max({'s': l_returnflag, 'c': CASE WHEN l_tax > 0.04 THEN l_shipdate END}, l_linenumber) AS u FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN l_orderkey IS NOT NULL THEN u.s ELSE o_orderstatus END AS verdict, strftime(coalesce(u.c, o_orderdate), '%Y-%m-%d') AS entrypoint FROM orders LEFT JOIN u ON l_orderkey = o_orderkey
""")
def verdict_merge(spark, d):
    """Order status overwritten by the last line's flag; its date only where that is not null. Of lines with one number the first in the table counts."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderdate").alias("entrypoint"))
    u = placed(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_returnflag").alias("verdict"), F.when(F.col("l_tax") > 0.04, F.col("l_shipdate")).alias("entrypoint"), "__place")
    last = M.first_per_key(u, ["id"], [F.desc("l_linenumber"), "__place"])
    return M.merge_verdicts(c, last).select("id", "verdict", F.date_format("entrypoint", "yyyy-MM-dd").alias("entrypoint"))


_ORDER_VERDICT = "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'needs_review' ELSE o_orderstatus END"


@query(f"""
SELECT count(*) AS total, count_if(v = 'verified') AS verified, count_if(v = 'needs_review') AS needs_review, count_if(v = 'false_positive') AS false_positive,
       count_if(v IS NULL OR v NOT IN ('verified', 'needs_review', 'false_positive')) AS pending FROM (SELECT {_ORDER_VERDICT} AS v FROM orders)
""")
def bucket_report(spark, d):
    status = F.col("o_orderstatus")
    return M.bucket_counts(table(spark, d, "orders").select(F.when(status == "F", "verified").when(status == "O", "needs_review").otherwise(status).alias("verdict")))


@query("""
WITH t AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)
SELECT o_orderkey, (SELECT count(*) FROM orders) - (SELECT count(*) FROM t) AS truncated FROM t
""")
def budget_truncate(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count()
    kept = M.budget(orders, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return kept.select("o_orderkey", F.lit(max(0, n - K.REVIEW_BUDGET)).cast("long").alias("truncated"))


@query("""
WITH w AS (SELECT *, lag(role) OVER p AS pr, lag(text) OVER p AS pt, lead(role) OVER p AS nr FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, turn, 'Function: ' || role || chr(10) || 'Called by:' || chr(10) ||
  CASE WHEN pr IS NULL THEN 'none found' ELSE '- ' || pr || chr(10) || array_to_string(string_split(pt, chr(10))[1:15], chr(10)) END || chr(10) || 'Calls: ' || coalesce(nr, 'none found') AS t FROM w)
SELECT conv_id, turn, CASE WHEN length(t) > 6000 THEN substr(t, 1, 6000) || chr(10) || '... (truncated)' ELSE t END AS context FROM c
""")
def call_neighbors(spark, d):
    """The turn before as caller, with a preview; the turn after as callee."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.concat(F.lit("- "), F.lag("role").over(w), F.lit("\n"), S.first_lines(F.lag("text").over(w))), F.lit("none found"))
    text = F.concat(F.lit("Function: "), "role", F.lit("\nCalled by:\n"), before, F.lit("\nCalls: "), F.coalesce(F.lead("role").over(w), F.lit("none found")))
    return table(spark, d, "conversations").select("conv_id", "turn", S.truncate_context(text).alias("context"))


@query("""
SELECT event_id, s_id AS signup_id FROM (
  SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_id FROM events)
""")
def event_asof(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").select("event_id", last.alias("signup_id"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n, string_agg(l_orderkey::VARCHAR || '-' || l_linenumber, ',' ORDER BY l_orderkey::VARCHAR || '-' || l_linenumber) AS ids FROM lineitem GROUP BY 1, 2")
def key_dup_expand(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    return M.duplicate_ids(rows, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


_LANG_KEYS = {"en": "python", "fr": "Java", "de": "TypeScript", "es": "go"}


@query(
    "SELECT doc_id, CASE lang "
    + " ".join(
        f"WHEN '{k}' THEN '{'|'.join(dict.fromkeys([*K.COMMON_SIGNALS, *K.LANGUAGES[{'Java': 'java', 'TypeScript': 'js'}.get(v, v)][3]]))}'" for k, v in _LANG_KEYS.items()
    )
    + f" ELSE '{'|'.join(K.COMMON_SIGNALS)}' END AS signals FROM documents"
)
def signal_ordered_union(spark, d):
    """Common signals, then those of the language a document's tongue stands for."""
    name = F.lit("none")
    for k, v in _LANG_KEYS.items():
        name = F.when(F.col("lang") == k, v).otherwise(name)
    return table(spark, d, "documents").select("doc_id", F.array_join(S.resource_signals(name), "|").alias("signals"))


_TYPED = {"en": "python", "fr": "java", "de": "c", "es": "go"}
_CAMEL = "regexp_extract_all(t, '\\b[A-Z][a-zA-Z0-9_]+\\b')"


def _declared(language: str) -> str:
    return f"regexp_extract_all(t, '\\b(?:{'|'.join(K.LANGUAGES[language][2])})\\s+([A-Za-z_][A-Za-z0-9_]*)\\b', 1)"


@query(
    "WITH d AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', ' ', 'g') || ' class foo: ID size_t' || doc_id % 3 || '_t struct Box_1 record point type String' AS t FROM documents), "
    + "x AS (SELECT doc_id, list_distinct(CASE lang "
    + " ".join(
        f"WHEN '{k}' THEN {_CAMEL} || {_declared(v)}" + (" || regexp_extract_all(t, '\\b[a-z0-9_]+_t\\b')" if v == "c" else "") for k, v in _TYPED.items()
    )
    + " ELSE [] END) AS x FROM d) "
    + "SELECT doc_id, array_to_string(list_sort(list_filter(x, lambda n: n NOT IN ("
    + quoted(K.IGNORED_TYPES)
    + ")))[1:8], ',') AS types FROM x"
)
def typed_names(spark, d):
    """The first eight types of a text by the rules of the language that its tongue stands for; other tongues have none."""
    # word boundaries are ASCII in the twin; the tail has every kind of name
    tail = F.concat(F.lit(" class foo: ID size_t"), (F.col("doc_id") % 3).cast("string"), F.lit("_t struct Box_1 record point type String"))
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", " "), tail)
    language = F.lit("none")
    for k, v in _TYPED.items():
        language = F.when(F.col("lang") == k, v).otherwise(language)
    return table(spark, d, "documents").select("doc_id", F.array_join(S.type_names(text, language), ",").alias("types"))


def _all() -> None:
    """The audit's own queries register themselves when first asked for."""
    from lodestone.plans import audit_queries, project_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
