"""Exact cosine top-k, rule pruning, incremental snapshots and the resource quota."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import constants as K
from lodestone.operators.nearest import top_rows


#: Intents held against the index at once; more are worked off in blocks of this many.
INTENT_BLOCK = 4096


def cosine_top_k(index: DataFrame, intents: DataFrame, k: int, floor: float | None = None, order: tuple = ("file", "name"), digits: int | None = None) -> DataFrame:
    """For each of ``intents(intent_id, query)`` the k best rows of ``index(order..., embedding)``, with ``score`` and ``rank``.

    Ties go by ``order``, scores being rounded to ``digits`` (twelve, if not given); a score under
    ``floor`` is dropped after the k were taken. Rows without a vector of the intents' length have
    no score and are left out. Intents are the stated query set: their number is checked, and each
    block of them is one small matrix that every task holds. A task keeps k rows an intent, so
    neither pairs nor their scores are shuffled or sorted, only those rows are merged.
    """
    n, out = intents.count(), None
    blocks = max(1, -(-n // INTENT_BLOCK))
    order = list(order)
    payload = list(dict.fromkeys([*order, *(c for c in index.columns if c != "embedding")]))
    schema = T.StructType([intents.schema["intent_id"], *(index.schema[c] for c in payload), T.StructField("score", T.DoubleType())])
    for b in range(blocks):
        part = intents if blocks == 1 else intents.where(F.pmod(F.xxhash64("intent_id"), F.lit(blocks)) == b)
        asked = part.where("query is not null").select("intent_id", F.col("query").cast("array<double>").alias("query")).toArrow().combine_chunks()  # at most a block
        sizes = set(pc.list_value_length(asked["query"]).to_pylist())
        for size in sorted(sizes) or [0]:
            same = asked.filter(pc.equal(pc.list_value_length(asked["query"]), size)).combine_chunks()
            if not same.num_rows:
                continue
            matrix = same["query"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(same.num_rows, size)
            step = top_rows(matrix, same["intent_id"].combine_chunks(), "intent_id", k, order, 12 if digits is None else digits)
            top = index.select("embedding", *payload).mapInArrow(step, schema)
            out = top if out is None else out.unionByName(top)
    if out is None:
        out = index.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("intent_id").orderBy(F.desc("score"), *order)
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked if floor is None else ranked.where(F.col("score") >= floor)


def found_tags(files: DataFrame, rules: dict[str, tuple[list[str], list[str]]] = K.PRESCAN_RULES, text: str = "content") -> DataFrame:
    """``tag, found``: whether any file has one of the tag's patterns, whatever its case. One pass."""
    cols = [F.coalesce(F.bool_or(F.col(text).rlike("(?i)(" + "|".join(p) + ")")), F.lit(False)).alias(tag) for tag, (p, _) in rules.items()]
    one = files.agg(*cols)
    return one.unpivot([], list(rules), "tag", "found") if rules else one


def rule_classes(spark, rules: dict[str, tuple[list[str], list[str]]] = K.PRESCAN_RULES) -> DataFrame:
    return spark.createDataFrame([(tag, c) for tag, (_, classes) in rules.items() if not tag.startswith("_") for c in classes], "tag string, id string")


def prune(catalog: DataFrame, mapping: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Rows that no rule maps, or that a found tag maps. ``mapping(tag, key)`` and ``found(tag)``."""
    live = mapping.join(found.select("tag").distinct(), "tag", "left_semi").select(key).distinct().withColumn("__live", F.lit(True))
    mapped = mapping.select(key).distinct().withColumn("__mapped", F.lit(True))
    joined = catalog.join(mapped, key, "left").join(live, key, "left")
    return joined.where("__mapped is null or __live").drop("__mapped", "__live")


def compare_snapshots(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "md5") -> DataFrame:
    """``key, state``: unchanged, changed, deleted or new; a null digest in ``new`` (unreadable) is changed."""
    o = old.select(F.col(key), F.col(digest).alias("__o"), F.lit(True).alias("__old"))
    n = new.select(F.col(key), F.col(digest).alias("__n"), F.lit(True).alias("__new"))
    state = F.when(F.col("__new").isNull(), "deleted").when(F.col("__old").isNull(), "new").when(F.col("__o") == F.col("__n"), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def resource_hits(events: DataFrame, known: DataFrame, limit: int = K.RESOURCE_LIMIT) -> DataFrame:
    """The events that the resource quota lets through, with ``fresh``: whether their name is new to the task.

    ``events(task_id, signal_ord, phase, ord, name, file)``: definitions (phase 0) before usages
    (phase 1), signals in order. New names count against the quota, names that another road found
    do not; a usage phase looks at no more distinct (name, file) pairs than the quota has left when
    it begins. The bound is recursive, so a task's events, at most some hundreds by the fetch
    limits, are one sorted array that a higher-order function folds.
    """
    # a usage of one (name, file) is looked at once a signal
    event = F.struct("signal_ord", "phase", "ord", "name", "file")
    uses = events.where("phase = 1").groupBy("task_id", "signal_ord", "phase", "name", "file").agg(F.min("ord").alias("ord"))
    todo = events.where("phase = 0").unionByName(uses.select(*events.columns)).groupBy("task_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    names = known.groupBy("task_id").agg(F.collect_set("name").alias("known"))
    kinds = {c: events.schema[c].dataType.simpleString() for c in events.columns}
    hit = f"struct<signal_ord:{kinds['signal_ord']},phase:{kinds['phase']},ord:{kinds['ord']},name:{kinds['name']},file:{kinds['file']},fresh:boolean>"
    none = F.array().cast(f"array<{kinds['name']}>")
    start = F.struct(
        F.lit(0).alias("added"), F.lit(0).alias("room"), F.lit(None).cast(kinds["signal_ord"]).alias("open"), none.alias("names"), F.array().cast(f"array<{hit}>").alias("hits")
    )
    known_names = F.coalesce("known", none)

    def step(state: Column, e: Column) -> Column:
        usage = e["phase"] == 1
        begins = usage & ~F.coalesce(state["open"] == e["signal_ord"], F.lit(False))
        room = F.when(begins, F.lit(limit) - state["added"]).otherwise(state["room"])
        seen = F.when(usage, room > 0).otherwise(state["added"] < limit)
        fresh = ~F.array_contains(known_names, e["name"]) & ~F.array_contains(state["names"], e["name"])
        one = F.struct(*(e[c].alias(c) for c in ("signal_ord", "phase", "ord", "name", "file")), fresh.alias("fresh"))
        return F.struct(
            (state["added"] + F.when(seen & fresh, 1).otherwise(0)).alias("added"),
            F.when(usage, room - 1).otherwise(room).alias("room"),
            F.when(usage, e["signal_ord"]).otherwise(state["open"]).alias("open"),
            F.when(seen & fresh, F.array_append(state["names"], e["name"])).otherwise(state["names"]).alias("names"),
            F.when(seen, F.array_append(state["hits"], one)).otherwise(state["hits"]).alias("hits"),
        )

    folded = todo.join(names, "task_id", "left").select("task_id", F.explode(F.aggregate("events", start, step, lambda s: s["hits"])).alias("h"))
    return folded.select("task_id", "h.*")


def resource_quota(events: DataFrame, known: DataFrame, limit: int = K.RESOURCE_LIMIT) -> DataFrame:
    """New names that resource signals add to each task, by the sequential quota (see resource_hits)."""
    return resource_hits(events, known, limit).where("fresh").drop("fresh")


def ordered_quota(events: DataFrame, known: DataFrame, limit: int = K.RESOURCE_LIMIT) -> DataFrame:
    """The same as a plain rank of new names, distributed over any number of events; not equivalent
    where the recursive bound bites."""
    new = events.join(known.select("task_id", "name").distinct(), ["task_id", "name"], "left_anti")
    first = Window.partitionBy("task_id", "name").orderBy("signal_ord", "phase", "ord")
    once = new.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    w = Window.partitionBy("task_id").orderBy("signal_ord", "phase", "ord")
    return once.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")
