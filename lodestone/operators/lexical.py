"""Ranked lookup of symbols by the words of their names: an inverted index with word weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.operators.merging import first_n

#: Queries looked up at once; more are worked off in blocks of this many.
QUERY_BLOCK = 4096


def name_words(text: Column) -> Column:
    """Distinct lower-case words of two letters or more; a word also begins where a capital follows a small letter or digit."""
    parted = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda w: F.length(w) > 1))


def places(symbols: DataFrame) -> DataFrame:
    """``file, name, line, times``: each symbol once, and how often it is listed."""
    return symbols.groupBy("file", "name", "line").agg(F.count("*").alias("times"))


def names_of(rows: DataFrame) -> DataFrame:
    """``name, times, n``: each name of ``places`` once, and how many places have it as often."""
    return rows.groupBy("name", "times").agg(F.count("*").alias("n"))


def texts_of(asked: DataFrame, key: str) -> DataFrame:
    """``key, texts``: all texts of a query, so that queries with the same texts are looked up once."""
    return asked.groupBy(key).agg(F.sort_array(F.collect_list("text")).alias("texts"))


def best_places(scored: DataFrame, rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` places of each ``texts`` from ``scored(texts, name, times, ...)``, by ``order``, file, name and line.

    Places of a name have one score, so of a name its first ``limit`` places are enough, and of the
    names those that fewer than ``limit`` others precede.
    """
    near = scored.withColumn("__r", F.rank().over(Window.partitionBy("texts").orderBy(*order))).where(F.col("__r") <= limit).drop("__r")
    first = first_n(rows, ["name", "times"], ["file", "line"], limit).drop("rank")
    return first_n(near.join(first, ["name", "times"]), ["texts"], [*order, "file", "name", "line"], limit)


def word_weights(entries: DataFrame, n_symbols: int) -> DataFrame:
    """``word, weight`` of ``entries(word, n)``: the rarer among ``n_symbols`` names a word is, the more it weighs."""
    n = F.col("n")
    return entries.groupBy("word").agg(F.sum("n").alias("n")).select("word", F.log(F.lit(1.0) + (F.lit(float(n_symbols)) - n + 0.5) / (n + 0.5)).alias("weight"))


def lookup(symbols: DataFrame, asked: DataFrame, limit: int = K.LEXICAL_LIMIT) -> DataFrame:
    """``query_id, file, name, line, score, rank``: for each of ``asked(query_id, text)`` the best symbols.

    Of the names that share a word with the query one that is the query itself, whatever its case,
    comes first; then the weights of the shared
    words count, over the root of the name's number of words; ties go by file, name and line. Symbols of
    one name and queries of one text are scored once, so the pairs grow with distinct names and
    texts, not with rows. Only the queries' own words leave the index: they are the stated query set,
    whose number is checked, and each block of them is broadcast, so no word's postings are gathered
    in one task and only partly summed matches are shuffled.
    """
    n, rows, said = symbols.count(), places(symbols), texts_of(asked, "query_id")
    texts = said.select("texts").distinct()
    blocks = max(1, -(-texts.count() // QUERY_BLOCK))
    names = names_of(rows).select("name", "times", (F.col("n") * F.col("times")).alias("n"), name_words(F.col("name")).alias("words"))
    entries, out = names.select(F.explode("words").alias("word"), F.size("words").alias("n_words"), "name", "times", "n"), None
    for b in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("texts"), F.lit(blocks)) == b)
        words = part.select("texts", F.explode("texts").alias("text")).select("texts", F.lower("text").alias("__text"), F.explode(name_words(F.col("text"))).alias("word"))
        wanted = entries.join(F.broadcast(words.select("word").distinct()), "word", "left_semi")
        weighted = words.join(word_weights(wanted, n), "word")  # at most one row a query and word
        hits = entries.join(F.broadcast(weighted), "word").groupBy("texts", "__text", "name", "times", "n_words").agg(F.sum(F.col("weight") * F.col("times")).alias("__sum"))
        score = F.round(F.col("__sum") / F.sqrt(F.col("n_words").cast("double")), 9)
        scored = hits.select("texts", "name", "times", (F.lower("name") == F.col("__text")).alias("__same"), score.alias("score"))
        top = best_places(scored, rows, [F.desc("__same"), F.desc("score")], limit)
        out = top if out is None else out.unionByName(top)
    return said.join(out, "texts").select("query_id", "file", "name", "line", "score", "rank")
