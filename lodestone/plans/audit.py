"""The audit end to end: plan, incremental index, recall over three roads, verdicts, gaps."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import scalars as S
from lodestone.operators import lexical as X
from lodestone.operators import lines as L
from lodestone.operators import merging as M
from lodestone.operators import retrieval as R
from lodestone.operators.numbering import running_numbers
from lodestone.plans import report
from lodestone.sources import files as sources
from lodestone.sources.catalog_xml import load_catalog
from lodestone.sources.stores import TASK, SnapshotStore, languages_of, load_rules, read_catalog_json, workspace, write_catalog_json, write_packages, write_text

DIMENSIONS = 384


def hash_embedder(dimensions: int = DIMENSIONS) -> Callable[[Column], Column]:
    """A stand-in for a model: signed hashed words, unit length. Any pandas UDF of the same shape fits."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import re
        import zlib

        def one(text):
            v = np.zeros(dimensions, np.float32)
            for w in re.findall(r"[a-z0-9]+", (text or "").lower().replace("_", " ")):
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1 if h >> 31 else -1
            n = float(np.linalg.norm(v))
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


# --- plan -----------------------------------------------------------------------------------------


def init_plan(catalog: DataFrame, files: DataFrame, language: str = "auto", rules: dict | None = None) -> tuple[DataFrame, str]:
    """Tasks for the weaknesses that the found technology calls for, and the language."""
    spark, rules = catalog.sparkSession, rules or K.PRESCAN_RULES
    language = sources.dominant_language(files) if language == "auto" else language
    # technology counts in whatever language of the project it is found
    found = R.found_tags(sources.prescan_files(files, S.source_extensions()), rules).where("found")
    kept = R.prune(catalog, R.rule_classes(spark, rules), found)
    tasks = kept.select(
        F.concat(F.lit("task-cwe-"), "id").alias("id"), F.col("id").alias("cwe_id"), F.col("name").alias("cwe_name"), "description",
        F.array().cast("array<string>").alias("query_intents"), F.lit("").alias("vulnerability_prompt"), F.lit("pending").alias("status"), F.array("id").alias("all_cwes"),
    )
    return tasks, language


def tasks_needing_intents(tasks: DataFrame) -> DataFrame:
    return tasks.where(~S.semantic_intents(F.col("query_intents"))).select("id", "cwe_id", "cwe_name", "description")


def merge_intents(tasks: DataFrame, intents: DataFrame) -> DataFrame:
    """Intents (and prompts, classes) of ``intents(id, query_intents, ...)`` put into their tasks; without any, keywords of the name."""
    given = [c for c in ("query_intents", "vulnerability_prompt", "all_cwes") if c in intents.columns]
    joined = tasks.join(intents.select("id", *(F.col(c).alias(f"__{c}") for c in given)), "id", "left")
    for c in given:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    fallback = F.array(S.keyword_fallback(F.col("cwe_name")))
    return joined.withColumn("query_intents", F.when(F.size("query_intents") > 0, F.col("query_intents")).otherwise(fallback)).select(*tasks.columns)


# --- index ----------------------------------------------------------------------------------------


def build_index(files: DataFrame, store: SnapshotStore, language: str = K.DEFAULT_LANGUAGE, embed: Callable[[Column], Column] | None = None) -> dict[str, int]:
    """Bring the stored index up to the files: only functions of new and changed files are embedded,
    and only buckets with a file that is new, changed or gone are written.

    A file whose symbols or source can't be had gets no digest, so it is tried again next time.
    Returns how many files are unchanged, changed, deleted and new.
    """
    spark, embed = files.sparkSession, embed or hash_embedder()
    extensions = K.LANGUAGES.get(K.LANGUAGE_ALIASES.get(language, language), ([],))[0]
    now = sources.index_files(files, extensions).select("path", "content", "md5")
    index, digests = store.bucketed("index", "file"), store.bucketed("digests", "path")
    old = store.read("digests") if store.exists("digests") and store.exists("index") else spark.createDataFrame([], "path string, md5 string")
    states = store.write("states", R.compare_snapshots(old, now))
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    if not (counts.keys() - {"unchanged"}) and store.exists("index"):
        return counts
    todo = now.join(states.where("state in ('new', 'changed')"), "path", "left_semi")
    lines = L.explode_lines(todo.withColumnRenamed("path", "file"), ["file"])
    symbols = L.first_symbols(L.symbols_of(lines), [F.col("line")])
    code = L.symbol_sources(symbols, lines)
    fresh = code.withColumn("embedding", embed(S.embed_text(F.col("name"), F.col("code"))))
    moved = states.where("state <> 'unchanged'").select("path")
    # digests come last: after a failure between the two the same files are done again
    index.replace(moved.withColumnRenamed("path", "file"), fresh.select("file", "name", "line", "code", "embedding"))
    digests.replace(moved, todo.select("path", "md5"))
    return counts


def index_size(store: SnapshotStore) -> int:
    return store.size("index")


def search(index: DataFrame, intents: DataFrame, k: int = 30, floor: float = 0.0, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Best functions for each of ``intents(intent_id, text)``."""
    asked = intents.select("intent_id", (embed or hash_embedder())(F.col("text")).alias("query"))
    return R.cosine_top_k(index.select("file", "name", "line", "embedding"), asked, k, floor)


# --- recall ---------------------------------------------------------------------------------------


def lexical(index: DataFrame, intents: DataFrame, limit: int = K.LEXICAL_LIMIT) -> DataFrame:
    """Functions whose name shares words with an intent, most shared words first: the plain count, without
    the weights by which ``explore`` ranks (operators.lexical). Functions of one name and intents of one text are matched once."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda x: F.length(x) > 2))
    rows, said = X.places(index), X.texts_of(intents, "intent_id")
    names = X.names_of(rows).select("name", "times", F.explode(split(F.col("name"))).alias("word"))
    asked = said.select("texts").distinct().select("texts", F.explode("texts").alias("text")).select("texts", F.explode(split(F.col("text"))).alias("word"))
    scored = names.join(asked, "word").groupBy("texts", "name", "times").agg((F.count("*") * F.col("times")).alias("shared"))
    top = X.best_places(scored, rows, [F.desc("shared")], limit)
    return said.join(top, "texts").select("intent_id", "file", "name", "line", "shared", "rank")


def call_edges(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """``src, dst, file, line``: the first call of each known function in each other function."""
    known = symbols.select(F.col("name").alias("dst")).distinct()
    calls = F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))
    both = F.struct(S.header_name(F.col("line"), strict=True).alias("name"), calls.alias("calls"))
    rows = lines.select("file", "line_no", L.only_if(both, lambda x: x["name"].isNotNull() | (F.size(x["calls"]) > 0)).alias("__at")).select("file", "line_no", F.col("__at.name").alias("__name"), F.col("__at.calls").alias("__calls"))
    above = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.withColumn("src", F.last("__name", ignorenulls=True).over(above)).where("src is not null")
    called = owned.select("file", "line_no", "src", F.explode("__calls").alias("dst")).where("src <> dst")
    return called.groupBy("src", "dst", "file").agg(F.min("line_no").alias("line")).join(known, "dst").select("src", "dst", "file", "line")


def fallback_edges(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``src, dst, file, line``: functions in whose lines a name of ``names(dst)`` stands as a word.

    A line that defines the name, or a name within it, is no use of it. A use within the function
    itself counts for the next header above that has another name. The distinct names are broadcast,
    so that the words of all lines are not shuffled.
    """
    words = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)))
    said = lines.select("file", "line_no", S.defined_name(F.col("line")).alias("__own"), words.alias("dst"))
    used = said.join(F.broadcast(names.select("dst").distinct()), "dst").where(~F.coalesce(F.contains("dst", "__own"), F.lit(False)))
    owned = L.headed(used.select("file", "line_no", "dst"), L.headers_of(lines), avoid="dst")
    return owned.groupBy(F.col("enclosing").alias("src"), "dst", "file").agg(F.min("line_no").alias("line"))


def callers_of(names: DataFrame, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Up to ten callers of each of ``names(dst)`` by call edges; a name without any by its uses in the text."""
    primary = edges.join(names.select("dst").distinct(), "dst", "left_semi").select("src", "dst", "file", "line")
    bare = names.select("dst").distinct().join(primary.select("dst").distinct(), "dst", "left_anti")
    both = primary.withColumn("is_fallback", F.lit(False)).unionByName(fallback_edges(lines, bare).select("src", "dst", "file", "line").withColumn("is_fallback", F.lit(True)))
    return M.neighbours(both.withColumn("ord", F.struct("file", "line", "src")))


def contexts(candidates: DataFrame, edges: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """``function, context, first_caller``: callers (the first three with a preview) and callees, each with its file.

    A callee's file is that of its first definition. ``symbols`` without ``code`` get their sources
    from ``lines``, only those of files that a preview is taken from. Each function has at most ten of either, so
    both lists are gathered in one grouping.
    """
    asked = candidates.select("function").distinct()
    callers = callers_of(asked.select(F.col("function").alias("dst")), edges, lines)
    coded = symbols
    if "code" not in symbols.columns:
        files = F.broadcast(callers.where(F.col("rank") <= K.CONTEXT_SOURCES).select("file").distinct())
        coded = L.symbol_sources(symbols.join(files, "file", "left_semi"), lines.join(files, "file", "left_semi"))
    previews = coded.select(F.col("name").alias("src"), "file", F.trim(S.first_lines(F.col("code")), F.lit(" \n\t\r")).alias("preview"))
    fence = F.concat(F.lit(":\n```\n"), "preview", F.lit("\n```"))
    label = F.concat("src", F.lit(" ("), "file", F.lit(")"))
    told = F.concat(F.lit("- "), label, F.when((F.col("rank") <= K.CONTEXT_SOURCES) & (F.col("preview") != ""), fence).otherwise(F.lit("")))
    up = callers.join(previews, ["src", "file"], "left").select(F.col("dst").alias("function"), F.lit(True).alias("up"), "rank", told.alias("text"), "src")
    first = edges.join(asked, F.col("src") == F.col("function"), "left_semi").groupBy("src", "dst").agg(F.min(F.struct("file", "line")).alias("at"))
    homes = symbols.groupBy(F.col("name").alias("dst")).agg(F.min(F.struct("file", "line"))["file"].alias("home"))
    down = M.first_n(first.join(homes, "dst", "left"), ["src"], ["at", "dst"], K.NEIGHBOUR_LIMIT)
    label = F.concat("dst", F.coalesce(F.concat(F.lit(" ("), "home", F.lit(")")), F.lit("")))
    down = down.select(F.col("src").alias("function"), F.lit(False).alias("up"), "rank", label.alias("text"), F.lit(None).cast("string").alias("src"))
    side = lambda up: F.transform(F.array_sort(F.collect_list(F.when(F.col("up") == up, F.struct("rank", "text")))), lambda x: x["text"])
    near = up.unionByName(down).groupBy("function").agg(side(True).alias("callers"), side(False).alias("callees"), F.min_by("src", F.when(F.col("up"), F.col("rank"))).alias("first_caller"))
    some = lambda c, between, none: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.array_join(c, between)).otherwise(F.lit(none))
    named = lambda text: F.concat(F.lit(text.split("{}")[0]), "function", F.lit(text.split("{}")[1]))
    text = F.concat_ws(
        "\n", F.lit(K.CONTEXT_TITLE), named(K.CONTEXT_CALLERS), some(F.col("callers"), "\n", K.CONTEXT_NO_CALLERS), F.lit(""), named(K.CONTEXT_CALLEES),
        F.concat(F.lit("  "), some(F.col("callees"), ", ", K.CONTEXT_NO_CALLEES)),
    )
    return asked.join(near, "function", "left").select("function", S.truncate_context(text).alias("context"), "first_caller")


def type_definitions(lines: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``type, definition``: the first definition of each type, whatever its kind, with its whole source.

    The source runs from the defining line to before the next definition of the file. With
    ``wanted(type)`` only those types are looked for, and only the lines of files that have the first
    definition of one are read on.
    """
    shape = rf"\b({'|'.join(K.DEFINITION_KINDS)})\s+([A-Za-z_][A-Za-z0-9_]*)"
    defined = lines.where(F.col("line").rlike(shape)).select("file", F.regexp_extract("line", shape, 2).alias("name"), F.col("line_no").cast("int").alias("line"), F.regexp_extract("line", shape, 1).alias("kind"))
    asked = defined if wanted is None else defined.join(wanted.select(F.col("type").alias("name")).distinct(), "name", "left_semi")
    first = asked.groupBy("name").agg(F.min(F.struct("file", "line", "kind")).alias("at")).select("name", "at.*")
    files = first.select("file").distinct()
    sources_ = L.symbol_sources(defined.join(files, "file", "left_semi"), lines.join(files, "file", "left_semi"))
    found = sources_.join(first, ["file", "name", "line"])
    return found.select(F.col("name").alias("type"), F.concat(F.lit("// Definition for "), "kind", F.lit(" "), "name", F.lit("\n"), "code").alias("definition"))


def definitions(candidates: DataFrame, lines: DataFrame, language: str) -> DataFrame:
    """``id, struct_definitions``: the definitions of the first types of a snippet."""
    wanted = candidates.select("id", F.posexplode(S.type_names(F.col("code"), F.lit(language))).alias("pos", "type"))
    found = wanted.join(type_definitions(lines, wanted), "type").groupBy("id")
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("definition").alias("t")))), lambda x: x["t"]), "\n\n").alias("struct_definitions"))


def explore(tasks: DataFrame, index: DataFrame, lines: DataFrame, language: str, embed: Callable[[Column], Column] | None = None, per_task: int = K.PER_TASK_LIMIT, floor: float = K.MIN_SCORE, recall_key: str = "file", observation: Observation | None = None) -> DataFrame:
    """Candidates of all tasks: vector, lexical and resource recall, merged, filtered, capped, deduplicated.

    ``observation`` gets how many rows each road added (see recall_union).

    ``recall_key='name'`` lets functions of one name share the first one's file, as a map keyed by
    name would.
    """
    spark, n = index.sparkSession, index.count()
    k = 30 if n <= 0 else int(max(5, min(30, round(n * 0.05))))
    intents = tasks.select(F.col("id").alias("task_id"), F.posexplode("query_intents").alias("pos", "text")).withColumn("intent_id", F.concat_ws("#", "task_id", F.col("pos").cast("string")))
    slot = intents.select("intent_id", "task_id", "pos")
    at = lambda road, rank: F.struct(F.lit(0).alias("late"), F.col("pos").cast("long").alias("a"), F.lit(road).alias("b"), rank.cast("long").alias("c"))
    vector = search(index, intents, k, floor, embed).join(slot, "intent_id").select("task_id", "file", "name", "line", F.lit("vector").alias("road"), at(0, F.col("rank")).alias("recall_ord"))
    symbol = X.lookup(index, intents.select(F.col("intent_id").alias("query_id"), "text")).withColumnRenamed("query_id", "intent_id").join(slot, "intent_id").select("task_id", "file", "name", "line", F.lit("symbol").alias("road"), at(1, F.col("rank")).alias("recall_ord"))
    signals = list(dict.fromkeys([*K.COMMON_SIGNALS, *K.LANGUAGES.get(K.LANGUAGE_ALIASES.get(language, language), ([], [], [], []))[3]]))
    logic = tasks.where(F.col("cwe_id").isin(K.LOGIC_CLASSES)).select(F.col("id").alias("task_id"))
    order = F.create_map(*(F.lit(x) for i, s in enumerate(signals) for x in (s, i)))
    used = L.usages(lines, signals).select(F.try_element_at(order, F.col("signal")).cast("long").alias("a"), F.lit(1).alias("b"), "file", F.col("enclosing").alias("name"), F.col("line_no").cast("int").alias("line"))
    plain = [s for s in signals if not ("." in s or "\\" in s)]
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(signals) if s in plain], "query_id long, text string")
    named = X.lookup(index, asked).select(F.col("query_id").alias("a"), F.lit(0).alias("b"), "file", "name", "line", F.col("rank").alias("c"))
    used = used.withColumn("c", F.row_number().over(Window.partitionBy("a").orderBy("file", "line")).cast("long"))
    hits = named.unionByName(used)
    events = logic.join(F.broadcast(hits.where(F.col("c") <= K.RESOURCE_LIMIT)), F.lit(True))
    events = events.select("task_id", F.col("a").alias("signal_ord"), F.col("b").alias("phase"), F.col("c").alias("ord"), "name", "file")
    recalled = vector.unionByName(symbol).select("task_id", "name", "file").distinct()
    quota = R.resource_quota(events, recalled.select("task_id", "name").distinct())
    upgraded = R.resource_hits(events, recalled.select("task_id", "name").distinct()).where(~F.col("fresh"))
    lines_of = hits.groupBy("name", "file").agg(F.min("line").alias("line"))
    resource = quota.join(lines_of, ["name", "file"]).select(
        "task_id", "file", "name", "line", F.lit("resource").alias("road"), F.struct(F.lit(1).alias("late"), F.col("signal_ord").alias("a"), F.col("phase").alias("b"), F.col("ord").alias("c")).alias("recall_ord")
    )
    seen = recalled.join(upgraded.select("task_id", "name").distinct(), ["task_id", "name"], "left_semi")
    again = seen.select("task_id", "file", "name", F.lit(0).alias("line"), F.lit("resource").alias("road"), F.struct(F.lit(2).alias("late"), F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c")).alias("recall_ord"))
    keys = ["task_id", "name"] if recall_key == "name" else ["task_id", "file", "name"]
    all_ = vector.unionByName(symbol).unionByName(resource).unionByName(again).withColumn("ord0", F.col("recall_ord"))
    merged = M.recall_union(all_, keys, observation=observation)
    extensions = K.LANGUAGES.get(K.LANGUAGE_ALIASES.get(language, language), ([],))[0]
    coded = merged.join(index.select("file", "name", "code"), ["file", "name"], "left")
    coded = coded.where(~S.blacklisted(F.col("file")) & S.extension_allowed(F.col("file"), extensions) & ~S.test_name(F.col("name"), F.lit(language)) & ~S.below_snippet_floor(F.col("code")))
    capped = M.first_n(coded, ["task_id"], ["ord0", "file", "name"], per_task)
    placed = capped.join(tasks.select(F.col("id").alias("task_id"), "cwe_id"), "task_id")
    placed = running_numbers(placed, [F.length("cwe_id"), "cwe_id", "rank"], "ord")
    raw = placed.select(F.col("name").alias("function"), "file", "line", "cwe_id", "task_id", "code", "recall_source", "ord")
    return M.numbered(M.dedup_candidates(raw, ["file", "function"], "ord"), ["ord"], "cand-uniq-")


def enrich(candidates: DataFrame, lines: DataFrame, index: DataFrame, language: str) -> DataFrame:
    edges = call_edges(lines, index)
    ctx = contexts(candidates, edges, index, lines)
    types = definitions(candidates, lines, language)
    out = candidates.join(ctx, "function", "left").join(types, "id", "left")
    return out.withColumn("entrypoint", S.entrypoint(F.col("first_caller"), F.col("file"))).withColumn("verdict", F.lit("pending")).withColumn("explanation", F.lit("")).drop("first_caller")


def packages(candidates: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidates with the names and prompts of their classes, in order, each once."""
    told = candidates.select("id", F.posexplode("matched_cwes").alias("pos", "cwe_id")).join(tasks.select("cwe_id", "cwe_name", "vulnerability_prompt"), "cwe_id", "left")
    ordered = lambda c: F.array_compact(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("t")))), lambda x: x["t"])))
    texts = told.groupBy("id").agg(ordered("cwe_name").alias("weaknesses"), F.array_join(F.filter(ordered("vulnerability_prompt"), lambda x: x != ""), "\n").alias("prompt"))
    return candidates.select("id", "file", "function", "cwe_id", "matched_cwes", "code", "context").join(texts, "id", "left")


def coverage(files: DataFrame, recalled: DataFrame) -> DataFrame:
    """Sink lines in functions that no candidate covers: ``file, function, line, content`` in order.

    Only files of the project's dominant language are scanned, with its own pattern.
    """
    language = sources.dominant_language(files, coverage=True)
    scanned = sources.coverage_files(files, language)
    lines = L.explode_lines(scanned.withColumnRenamed("path", "file"), ["file"])
    hits = lines.where(F.col("line").rlike(K.SINKS.get(language, K.SINKS["c/cpp"]))).select("file", "line_no", "line")
    symbols = L.symbols_of(lines.join(hits.select("file").distinct(), "file", "left_semi")).withColumn("listing_ord", F.col("line").cast("long"))
    gaps = L.coverage_gaps(hits, symbols, recalled)
    return gaps.select("file", "function", F.col("line_no").alias("line"), F.trim("line").alias("content")).orderBy("file", "function", "line")


# --- verdicts -------------------------------------------------------------------------------------


def update_verdict(store: SnapshotStore, candidate_id: str, verdict: str, explanation: str | None = None, **optional) -> DataFrame:
    """Put one verdict into the stored candidates; an unknown id or verdict is an error, a writer in between loses nothing."""
    return store.update("candidates", lambda c: M.merge_verdict(c, candidate_id, verdict, explanation, **optional))


def update_verdicts(store: SnapshotStore, updates: DataFrame) -> DataFrame:
    """Put updates (a row an id, see expand_updates) into the stored candidates; unknown ids are skipped."""
    return store.update("candidates", lambda c: M.merge_verdicts(c, updates))


# --- all of it --------------------------------------------------------------------------------------


@dataclass
class AuditConfig:
    project: str
    catalog: str
    workspace: str | None = None
    language: str = "auto"
    severity_threshold: int = K.SEVERITY_THRESHOLD
    limit: int = K.REVIEW_BUDGET
    strict: bool = False
    rules: str | None = None
    languages: str | None = None
    embed: Callable[[Column], Column] = field(default_factory=hash_embedder)


def run_pipeline(spark: SparkSession, cfg: AuditConfig, intents: DataFrame | None = None, severities: DataFrame | None = None, votes: DataFrame | None = None) -> dict:
    """Run every stage; judgement comes as tables of intents, severities and votes.

    Returns the report, the gaps' table and the bucket counts; without tasks or candidates the
    report says so and the later stages are left out.
    """
    with languages_of(cfg.languages):
        return _run(spark, cfg, intents, severities, votes)


def _run(spark: SparkSession, cfg: AuditConfig, intents: DataFrame | None, severities: DataFrame | None, votes: DataFrame | None) -> dict:
    where = workspace(cfg.project, cfg.workspace)
    store = SnapshotStore(spark, where["base"])
    files = sources.scan_files(spark, cfg.project).where(~F.startswith("path", F.lit(".audit_workspace/")))
    files = store.write("files", files)
    weaknesses = json.loads(write_catalog_json(load_catalog(spark, cfg.catalog, "all"), where["catalog"]))["count"]
    catalog = read_catalog_json(spark, where["catalog"])
    tasks, language = init_plan(catalog, files, cfg.language, load_rules(cfg.rules))
    tasks = merge_intents(tasks, intents if intents is not None else spark.createDataFrame([], "id string, query_intents array<string>"))
    tasks = store.write("tasks", tasks.select(*[c.split()[0] for c in TASK.split(", ")]))
    if tasks.isEmpty():
        return {"language": language, "tasks": 0, "report": report.markdown(None, 0), "gaps": None}
    build_index(files, store, language, cfg.embed)
    index = store.read("index")
    # usages and callers are looked for in every text of the project, whatever its language or folder
    lines = L.explode_lines(sources.text_files(files).withColumnRenamed("path", "file"), ["file"])
    added = Observation()
    found = store.write("found", explore(tasks, index, lines, language, cfg.embed, observation=added))
    sizes = {"classes": weaknesses, "retained": tasks.count(), "recalled": added.get}
    if found.isEmpty():
        return {"language": language, "tasks": tasks.count(), "report": report.markdown(None, tasks.count()), "gaps": coverage(files, found.select("file", "function"))}
    candidates = store.write("candidates", enrich(found, lines, index, language))
    store.write("packages", packages(candidates, tasks))
    write_packages(store.read("packages"), where["candidates"])
    left = M.truncated(candidates, cfg.limit)
    empty_votes = spark.createDataFrame([], "candidate_id string, lens string, is_real boolean, has_path boolean, has_missing boolean, reason string")
    empty_severity = spark.createDataFrame([], "candidate_id string, severity int")
    if votes is not None or severities is not None:
        updates = M.verify(candidates, severities if severities is not None else empty_severity, votes if votes is not None else empty_votes, cfg.severity_threshold, cfg.limit, cfg.strict)
        candidates = update_verdicts(store, updates.withColumnRenamed("candidate_id", "id"))
    counts = M.bucket_counts(candidates).first().asDict()
    gaps = coverage(files, candidates.select("file", "function"))
    roads = {r["recall_source"]: r["count"] for r in candidates.groupBy("recall_source").count().collect()}
    text = report.markdown(candidates, tasks.count(), votes if votes is not None else empty_votes, root=cfg.project)
    write_text(spark, where["report"], text)
    return {
        "language": language, "tasks": tasks.count(), "counts": counts, "truncated": left, "roads": roads, "sizes": sizes,
        "report": text, "gaps": gaps,
    }
