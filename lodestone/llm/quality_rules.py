"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WS_CLASS, array_literal, let, persist_table

#: Least number of buckets the word n-grams are hashed into, buckets for the square root of their count beyond
#: it, and the pseudo-count of each. Vocabularies grow about as the root of a text (Heaps), and a table that grew
#: in proportion would have 10**12 rows at 100 TB; so it has 4 * 10**8. A ratio learnt from n occurrences is
#: weighted by n / (n + SHRINK), so that rare n-grams say little.
BUCKETS, PER_ROOT, PSEUDO, SHRINK = 1 << 14, 46, 1.0, 200.0
#: Up to so many buckets the ratios are one literal, up to so many one array that tasks hold (256 MB at most);
#: beyond, a joined table.
LITERAL, HELD = 1 << 17, 1 << 25
#: N-grams that a task counts for each bucket, where there are more tasks than cores; so at most one row for so many
#: n-grams is shuffled, however many files the table has.
FILL = 32
#: Trusted ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A document is kept when its mean log-likelihood ratio per n-gram is at least this.
LEAST_RATIO = -0.06
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_CLASS), "")


def windows_of(words: Column, width: int) -> Column:
    """64-bit hashes of the consecutive ``width``-word windows."""
    n = F.size(words) - (width - 1)
    return F.when(
        n > 0,
        let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*(h[i + (k - 1)] for k in range(width)))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows found twice or more (the first finding included)."""

    def covered(at: Column) -> Column:
        """Words under windows that start at the sorted places ``at``."""
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda x, y: F.least(F.coalesce(y - x, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(sorted_: Column) -> Column:
        marked = F.transform(
            sorted_,
            lambda x, i: F.when(
                (x["h"] == F.get(sorted_, i - 1)["h"]) | (x["h"] == F.get(sorted_, i + 1)["h"]), x["i"]
            ),
        )
        return F.sort_array(F.array_compact(marked))

    def slow(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(places(s), covered))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(slow(w)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbouring words."""

    def both(h: Column) -> Column:
        single = F.transform(h, lambda a: F.pmod(a, F.lit(buckets)).cast("int"))
        pairs = F.zip_with(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), h, lambda b, a: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
        # the last pair has no right half
        return F.concat(single, F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), both)


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with __words and the base counts of the text."""
    text = F.col(text_col).cast("string")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return df.withColumn("__words", words_of(text)).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.coalesce(symbols, F.lit(0)).cast("long"),
            "n_dup_lines": duplicate_lines(text).cast("long"),
            "n_repeat_words": repeated_words(windows_of(F.col("__words"), WINDOW)).cast("long"),
        }
    )


def bucket_count(df: DataFrame, text_col: str = "text") -> int:
    """Buckets for the n-grams of ``df``: PER_ROOT times the square root of their count, BUCKETS at least."""
    return _buckets_for(ngram_count(df, text_col))


def _buckets_for(total: int) -> int:
    return max(BUCKETS, PER_ROOT * math.isqrt(total))


def ngram_count(df: DataFrame, text_col: str = "text") -> int:
    words = F.size(words_of(F.col(text_col).cast("string"))).cast("long")
    return df.agg(F.sum(F.greatest(2 * words - 1, F.lit(0)))).first()[0] or 0


@dataclass
class Ratios:
    """Log ratios of ``buckets`` buckets as a table ``b, ratio``; a bucket without a row has ratio 0."""

    table: DataFrame
    buckets: int

    def held(self) -> Column:
        """All ratios as one array literal in Spark's own layout: eight bytes a bucket, none boxed or parsed."""
        got, dense = self.table.toArrow(), np.zeros(self.buckets)
        dense[got["b"].to_numpy()] = got["ratio"].to_numpy()
        return array_literal(self.table.sparkSession, dense, "double")


def fit_ratios(
    df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> list[float] | Ratios:
    """Log ratio of each bucket's share in the trusted documents to its share in all documents.

    Counts cover every row of ``df``; ``trusted`` has the ids of the trusted ones in id_col. The
    buckets grow with the n-grams unless given. Up to LITERAL of them the ratios are a list; more
    stay a table. Without trusted documents every ratio is 0.
    """
    total = ngram_count(df, text_col)
    buckets = buckets or _buckets_for(total)
    marks = trusted.select(F.col(id_col).cast("long").alias("__id")).where("__id is not null").distinct().withColumn("__trusted", F.lit(1))
    # both sides grow with the corpus: only few ids are broadcast, which spares a shuffle of the texts
    how = "broadcast" if marks.count() <= BROADCAST_IDS else "merge"
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    marked = rows.join(marks.hint(how), "__id", "left")
    # a task hands on a row for each bucket it meets; so it takes FILL n-grams a bucket, unless cores would idle
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, total // (FILL * buckets))
    counted = (
        marked.coalesce(tasks).select(F.explode(ngram_buckets(words_of(F.col("__text")), buckets)).alias("b"), "__trusted")
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.count("__trusted").alias("target"))
    )
    if buckets > LITERAL:
        counted = persist_table(counted, "buckets")
        n, m = (x or 0 for x in counted.agg(F.sum("raw"), F.sum("target")).first())
        share = lambda c, total: F.log((F.col(c) + PSEUDO) / (total + PSEUDO * buckets))
        ratio = (share("target", m) - share("raw", n)) * F.col("raw") / (F.col("raw") + SHRINK)
        return Ratios(counted.select("b", (ratio if m else F.lit(0.0)).alias("ratio")), buckets)
    raw, target = np.full(buckets, PSEUDO), np.full(buckets, PSEUDO)
    for b, n, m in counted.collect():
        raw[b] += n
        target[b] += m
    if target.sum() == PSEUDO * buckets:
        return [0.0] * buckets
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return (ratio * (raw - PSEUDO) / (raw - PSEUDO + SHRINK)).tolist()


def mean_ratio(words: Column, ratios: list[float] | Ratios) -> Column:
    """Mean log-likelihood ratio of a text's n-grams; 0 without any."""
    if isinstance(ratios, Ratios):
        table, n = ratios.held(), ratios.buckets
    else:
        table, n = F.from_json(F.lit(json.dumps(ratios)), "array<double>"), len(ratios)  # folded into one literal
    total = let(ngram_buckets(words, n), lambda b: F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(table, x)) / F.size(b))
    return F.when(F.size(words) > 0, total).otherwise(F.lit(0.0))


def join_ratios(df: DataFrame, ratios: Ratios, text_col: str = "text") -> DataFrame:
    """``df`` with ``ratio``, the mean ratio of each text's n-grams, by joining these with the table.

    Equal texts are one key; hot buckets and texts are split by the skew join.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.withColumn("__key", F.unhex(F.md5(text)))
    grams = keyed.select("__key", F.explode(ngram_buckets(words_of(text), ratios.buckets)).alias("b"))
    means = grams.join(ratios.table.hint("merge"), "b", "left").groupBy("__key").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("__mean"))
    found = keyed.join(means.hint("merge"), "__key", "left")
    return found.withColumn("ratio", F.coalesce("__mean", F.lit(0.0))).drop("__key", "__mean")


def judge(df: DataFrame, ratios: list[float] | Ratios, least: float = LEAST_RATIO, text_col: str = "text") -> DataFrame:
    """``df`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept``.

    A null text counts as empty: no words, base_failed. Columns of ``df`` with these names are
    replaced. A text is one row throughout: no shuffle, and no work beyond n log n in its words;
    only for more than HELD buckets are its n-grams dealt out to look their ratios up.
    """
    joined = isinstance(ratios, Ratios) and ratios.buckets > HELD
    out = base_counts(join_ratios(df, ratios, text_col) if joined else df, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    if not joined:
        out = out.withColumn("ratio", mean_ratio(F.col("__words"), ratios))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least)).drop("__words")


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def apply_rules(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    ratios = fit_ratios(docs, trusted)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"]
    return judge(docs.select("doc_id", "text"), ratios).select(*cols)
