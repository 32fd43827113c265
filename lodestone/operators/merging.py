"""Dedup, provenance, votes, verdicts and their merge back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import scalars as S
from lodestone.operators.numbering import running_numbers


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int = K.PER_TASK_LIMIT) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


#: Roads of recall, as a tally lists them.
ROADS = ("vector", "symbol", "resource")


def recall_union(events: DataFrame, keys: list[str], order: str = "recall_ord", observation: Observation | None = None) -> DataFrame:
    """One row a key of ``events(keys, road, recall_ord, ...)``: the first event and its final source.

    vector and symbol become ``both`` once another road hits; resource stays. ``observation`` gets
    how many keys each road was the first to add, and their total, without a pass of its own.
    """
    payload = [c for c in events.columns if c not in keys]
    others = F.size(F.array_except(F.collect_set("road"), F.array(F.min_by("road", order))))
    out = events.groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("first"), others.alias("__others"))
    if observation is not None:
        out = out.observe(observation, *(F.count_if(F.col("first.road") == r).alias(r) for r in ROADS), F.count("*").alias("total"))
    source = F.when((F.col("first.road") != "resource") & (F.col("__others") > 0), "both").otherwise(F.col("first.road"))
    return out.select(*keys, *(F.col(f"first.{c}").alias(c) for c in payload if c != "road"), source.alias("recall_source"))


def dedup_candidates(candidates: DataFrame, keys: list[str], order: str, weakness: str = "cwe_id", source: str = "recall_source") -> DataFrame:
    """One candidate a key: payload of the first, classes by first appearance, strongest source.

    Of equally strong sources the earlier stays. ``cwe_id`` is the first class or MULTI without any.
    """
    payload = [c for c in candidates.columns if c not in (*keys, weakness, source)]
    best = lambda c: F.max_by(c, "__strength")
    # one row a key and class first, so that only a key's distinct classes are gathered
    strength = F.struct(S.source_rank(F.col(source)), (-F.col(order)).alias("o"))
    each = candidates.withColumn("__strength", strength).groupBy(*keys, F.col(weakness).alias("__class")).agg(
        F.min_by(F.struct(*payload), order).alias("__first"), F.min(order).alias("__order"), best(source).alias("__source"), F.max("__strength").alias("__strength")
    )
    classes = F.transform(F.array_sort(F.collect_list(F.struct(F.col("__order").alias("o"), F.col("__class").alias("c")))), lambda x: x["c"])
    out = each.groupBy(*keys).agg(F.min_by("__first", "__order").alias("first"), F.array_compact(classes).alias("matched_cwes"), best("__source").alias(source))
    return out.select(*keys, *(F.col(f"first.{c}").alias(c) for c in payload), "matched_cwes", source, F.coalesce(F.get("matched_cwes", F.lit(0)), F.lit("MULTI")).alias("cwe_id"))


def numbered(df: DataFrame, order: list[Column | str], prefix: str, column: str = "id") -> DataFrame:
    """Running ids in the given order, however many rows there are."""
    return running_numbers(df, order, "__n").withColumn(column, F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")


def duplicate_ids(df: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def budget(df: DataFrame, order: list[Column | str], limit: int = K.REVIEW_BUDGET) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def severity_gate(df: DataFrame, severity: str = "severity", threshold: int = K.SEVERITY_THRESHOLD) -> DataFrame:
    """``gate``: skip below the threshold, else review; an unknown severity is reviewed."""
    return df.withColumn("gate", F.when(F.col(severity) < threshold, "skip").otherwise("review"))


def tally_votes(votes: DataFrame, key: str = "candidate_id") -> DataFrame:
    """``n_true``, ``has_path`` (on a true vote), ``has_missing`` and the verdict of each candidate's votes."""
    real, path, missing = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_real", "has_path", "has_missing"))
    out = votes.groupBy(key).agg(F.count_if(real).alias("n_true"), F.bool_or(real & path).alias("has_path"), F.bool_or(missing).alias("has_missing"))
    return out.withColumn("verdict", S.triage(F.col("n_true"), F.col("has_path"), F.col("has_missing")))


def vote_explanation(votes: DataFrame, key: str = "candidate_id") -> DataFrame:
    """``explanation``: what the verdict means, true votes of three, then each lens in its order with its reason.

    A lens without a vote or reason has n/a; of several reasons of one lens the least is told.
    """
    tallied = tally_votes(votes, key).select(key, "verdict", "n_true")
    reason = lambda lens: F.coalesce(F.min(F.when(F.col("lens") == lens, F.nullif("reason", F.lit("")))), F.lit("n/a"))
    reasons = votes.groupBy(key).agg(*(reason(lens).alias(f"__{lens}") for lens in K.LENSES))
    told = [F.concat(F.lit(f"\n{i}. {lens}: "), f"__{lens}") for i, lens in enumerate(K.LENSES, 1)]
    return tallied.join(reasons, key).select(key, F.concat(_head(F.col("verdict")), F.lit(" (votes "), F.col("n_true").cast("string"), F.lit("/3)."), *told).alias("explanation"))


def _head(verdict: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, head in K.VERDICT_HEADS.items():
        out = out.when(verdict == name, head)
    return out


def truncated(candidates: DataFrame, limit: int = K.REVIEW_BUDGET, keys: tuple = ("file", "function", "cwe_id")) -> int:
    """Distinct pending targets beyond the review budget."""
    return max(0, candidates.where("verdict = 'pending'").select(*keys).distinct().count() - limit)


def verify(candidates: DataFrame, severities: DataFrame, votes: DataFrame, threshold: int = K.SEVERITY_THRESHOLD, limit: int | None = None, strict: bool = False, keys: tuple = ("file", "function", "cwe_id")) -> DataFrame:
    """Verdict updates for the pending candidates of ``candidates(id, verdict, ord, keys)``.

    One candidate a key is judged and its verdict goes to all of the key. Below the severity
    threshold: false_positive without votes. No surviving vote: false_positive, or needs_review if
    ``strict``. Beyond ``limit`` judged ones candidates stay pending and get no update.
    """
    pending = candidates.where("verdict = 'pending'")
    targets = first_per_key(pending, list(keys), ["ord"]).select("id", "ord", *keys)
    if limit is not None:
        targets = budget(targets, ["ord"], limit)
    why = F.coalesce(F.nullif("reason", F.lit("")), F.lit("n/a")) if "reason" in severities.columns else F.lit("n/a")
    given = severities.select(F.col("candidate_id").alias("id"), "severity", why.alias("__why"))
    gated = severity_gate(targets.join(given, "id", "left"), threshold=threshold)
    judged = gated.join(tally_votes(votes).select("candidate_id", "verdict").withColumnRenamed("candidate_id", "id"), "id", "left").join(vote_explanation(votes).withColumnRenamed("candidate_id", "id"), "id", "left")
    empty = "needs_review" if strict else "false_positive"
    skipped = F.concat(F.lit("Excluded — Security severity rated as "), F.col("severity").cast("string"), F.lit(f"/10 (below audit threshold {threshold}).\nReason: "), "__why")
    verdict = F.when(F.col("gate") == "skip", "false_positive").otherwise(F.coalesce("verdict", F.lit(empty)))
    silent = K.VERDICT_HEADS[empty] + " (votes 0/3)." + "".join(f"\n{i}. {lens}: n/a" for i, lens in enumerate(K.LENSES, 1))
    text = F.when(F.col("gate") == "skip", skipped).otherwise(F.coalesce("explanation", F.lit(silent)))
    judged = judged.select(*keys, verdict.alias("new_verdict"), text.alias("explanation"))
    out = pending.select("id", *keys).join(judged, list(keys))
    return out.select(F.col("id").alias("candidate_id"), F.col("new_verdict").alias("verdict"), "explanation")


def expand_updates(updates: DataFrame, order: str = "pos") -> DataFrame:
    """One row an id from ``candidate_id`` and ``candidate_ids``; of several the last counts."""
    ids = F.array_compact(F.concat(F.array("candidate_id"), F.coalesce("candidate_ids", F.array().cast("array<string>"))))
    flat = updates.withColumn("id", F.explode(ids)).drop("candidate_id", "candidate_ids")
    return first_per_key(flat, ["id"], [F.desc(order)]).drop(order)


def merge_verdicts(candidates: DataFrame, updates: DataFrame, required: tuple = ("verdict", "explanation"), optional: tuple = ("entrypoint", "votes")) -> DataFrame:
    """Candidates with their updates: required fields replaced, optional ones only by non-null values.

    ``updates`` has a row an id (see expand_updates); ids without a candidate are skipped.
    """
    have = [c for c in (*required, *optional) if c in updates.columns]
    u = updates.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in have))
    hit = F.col("__id").isNotNull()
    joined = candidates.join(u, F.col("id") == F.col("__id"), "left")
    put = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) if c in required else F.coalesce(f"__{c}", c) for c in have}
    return joined.select(*(put.get(c, F.col(c)).alias(c) for c in candidates.columns))


def merge_verdict(candidates: DataFrame, candidate_id: str, verdict: str, explanation: str | None = None, **optional) -> DataFrame:
    """A single update; an unknown id or verdict is an error."""
    if verdict not in ("verified", "needs_review", "false_positive"):
        raise ValueError(f"unknown verdict {verdict!r}")
    if not candidates.where(F.col("id") == candidate_id).limit(1).count():
        raise KeyError(candidate_id)
    hit, out = F.col("id") == candidate_id, candidates
    for name, value in {"verdict": verdict, "explanation": explanation, **{k: v for k, v in optional.items() if v is not None}}.items():
        out = out.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return out


def bucket_counts(candidates: DataFrame) -> DataFrame:
    """One row: total, and the count of every bucket; an unknown verdict counts as pending."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    known = F.col("verdict").isin("verified", "needs_review", "false_positive")
    return candidates.agg(
        F.count("*").alias("total"), is_("verified").alias("verified"), is_("needs_review").alias("needs_review"), is_("false_positive").alias("false_positive"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("pending"),
    )


def scanned_classes(explicit: int, from_candidates: int, tasks: int) -> int:
    """Classes scanned: an explicit list's size, else distinct classes of candidates, else tasks."""
    return explicit or from_candidates or tasks


def neighbours(edges: DataFrame, limit: int = K.NEIGHBOUR_LIMIT) -> DataFrame:
    """Callers of each ``dst`` from ``edges(src, dst, file, ord)``, primary first, fallbacks only without one."""
    w = Window.partitionBy("dst").orderBy("ord")
    primary = edges.where(~F.col("is_fallback"))
    fallback = edges.where("is_fallback").join(primary.select("dst").distinct(), "dst", "left_anti")
    return primary.unionByName(fallback).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
