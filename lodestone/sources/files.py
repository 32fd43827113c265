"""Source trees as rows ``path, content, md5``; paths are relative to the root."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as S


def scan_files(spark: SparkSession, root: str, extensions: Iterable[str] | None = None) -> DataFrame:
    """Every file below ``root``; the listing is distributed by Spark, broken UTF-8 is replaced."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    here = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    top = "/" + base.split(":", 1)[-1].strip("/") + "/"
    rows = raw.select(here.alias("__path"), "content")
    relative = F.when(F.startswith("__path", F.lit(top)), F.expr(f"substring(__path, {len(top) + 1})")).otherwise(F.col("__path"))
    out = rows.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), "content")
    out = out.select("path", F.coalesce("text", F.make_valid_utf8(F.col("content").cast("string"))).alias("content"), F.md5("content").alias("md5"))
    extensions = list(extensions or [])
    return out.where(S.extension_allowed(F.col("path"), extensions)) if extensions else out


def index_files(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """Files that go into the index: by extension, and without blacklisted segments."""
    return files.where(S.extension_allowed(F.col("path"), extensions) & ~S.blacklisted(F.col("path")))


def text_files(files: DataFrame) -> DataFrame:
    """Files a text search would read: not hidden, none of their folders hidden, and without a zero byte."""
    hidden = F.col("path").rlike(r"(^|/)\.[^/]")
    return files.where(~hidden & ~F.contains("content", F.lit("\0")))


def prescan_files(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    extensions = list(extensions)
    path = F.col("path")
    by_suffix = S.extension(path, lower=False).isin(extensions) if extensions else F.lit(True)
    return files.where(by_suffix & ~S.ignored_dir(path) & ~S.generated_file(path))


def coverage_files(files: DataFrame, language: str | None = None) -> DataFrame:
    """Files with sink patterns, of one language if given, outside the ignored folders."""
    lang = S.extension_language(F.col("path"), coverage=True)
    return files.where((lang.isNotNull() if language is None else lang == language) & ~S.ignored_dir(F.col("path"), coverage=True))


def language_counts(files: DataFrame, coverage: bool = False) -> DataFrame:
    """``lang, n``: files of each language outside the ignored folders; generated files count for coverage alone."""
    path = F.col("path")
    lang = S.extension_language(path, coverage)
    counted = files.where(~S.ignored_dir(path, coverage))
    if not coverage:
        counted = counted.where(~S.generated_file(path))
    return counted.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).where("lang is not null")


def dominant_language(files: DataFrame, coverage: bool = False) -> str:
    """Language of most files (ties: the first by name); ``cpp`` or ``c/cpp`` without any."""
    row = language_counts(files, coverage).orderBy(F.desc("n"), "lang").first()
    return row["lang"] if row else ("c/cpp" if coverage else "cpp")
