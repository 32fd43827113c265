"""Markdown reports: three buckets of candidates, and the table of coverage gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import merging as M

_SECTIONS = [("verified", "Verified"), ("needs_review", "Needs review"), ("false_positive", "False positives")]


def report_lines(candidates: DataFrame, votes: DataFrame | None = None, root: str = "") -> DataFrame:
    """``bucket, ord, text``: one Markdown entry a judged candidate, in plan order within its bucket.

    Only verified entries show attack paths and type definitions, only reviews missing evidence; the
    literal None stands for nothing.
    """
    spark = candidates.sparkSession
    notes = votes if votes is not None else spark.createDataFrame([], "candidate_id string, lens string")
    for c in ("attack_path", "missing"):
        if c not in notes.columns:
            notes = notes.withColumn(c, F.lit(None).cast("string"))
    said = lambda c: F.array_join(F.array_sort(F.collect_set(S.hide_none(F.col(c)))), "; ")
    notes = notes.groupBy(F.col("candidate_id").alias("id")).agg(said("attack_path").alias("__path"), said("missing").alias("__missing"))
    joined = candidates.join(notes, "id", "left")
    title = F.col("cwe_name") if "cwe_name" in candidates.columns else F.lit(None).cast("string")
    single = F.concat(F.lit("CWE-"), F.coalesce("cwe_id", F.lit("?")), F.lit(": "), F.coalesce(title, F.lit("")))
    types = F.col("struct_definitions") if "struct_definitions" in candidates.columns else F.lit(None).cast("string")

    def part(title: str, text: Column, when: Column) -> Column:
        return F.when(when & (F.coalesce(text, F.lit("")) != ""), F.concat(F.lit(f"\n- {title}: "), text)).otherwise(F.lit(""))

    verdict = F.col("verdict")
    text = F.concat(
        F.lit("### `"), "function", F.lit("` ("), S.weakness_label(F.col("matched_cwes"), single), F.lit(")\n- File: "), S.file_url(F.col("file"), root),
        part("Entry point", F.col("entrypoint"), F.lit(True)), part("Explanation", F.col("explanation"), F.lit(True)),
        part("Attack path", F.col("__path"), verdict == "verified"), part("Types", types, verdict == "verified"), part("Missing evidence", F.col("__missing"), verdict == "needs_review"),
    )
    return joined.where(verdict.isin([v for v, _ in _SECTIONS])).select(verdict.alias("bucket"), "ord", text.alias("text"))


def markdown(candidates: DataFrame | None, tasks: int, votes: DataFrame | None = None, scanned: int = 0, root: str = "") -> str:
    """The report as one text; a report is read by people, so its entries (those of the review
    budget) come to the driver."""
    if candidates is None:
        return "# Audit report\n\nNo candidates.\n"
    c = M.bucket_counts(candidates).first()
    classes = candidates.select(F.explode("matched_cwes").alias("c")).where("c <> 'MULTI'").distinct().count()
    rows = [("Classes scanned", M.scanned_classes(scanned, classes, tasks)), ("Candidates", c.total), ("Verified", c.verified), ("Needs review", c.needs_review), ("False positives", c.false_positive), ("Pending", c.pending)]
    out = ["# Audit report", "", "| Item | Count |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in rows)]
    if c.pending:
        out += ["", f"Not complete: {c.pending} candidates are pending."]
    entries = report_lines(candidates, votes, root).orderBy("bucket", "ord")
    by: dict[str, list[str]] = {}
    for r in entries.toLocalIterator():
        by.setdefault(r.bucket, []).append(r.text)
    for verdict, title in _SECTIONS:
        out += ["", f"## {title}", ""] + [f"{i}. {t}" for i, t in enumerate(by.get(verdict, []), 1)]
    return "\n".join(out) + "\n"


def gap_lines(gaps: DataFrame) -> DataFrame:
    """``file, function, line, row``: the gap table's rows, previews cut to eighty characters."""
    cell = F.replace(S.preview(F.col("content")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "file", "function", F.col("line").cast("string"), F.concat(F.lit("`"), cell, F.lit("`"))), F.lit(" |"))
    return gaps.select("file", "function", "line", row.alias("row"))


def gap_table(gaps: DataFrame) -> str:
    """The coverage gaps as a Markdown table, which people read."""
    rows = [r["row"] for r in gap_lines(gaps).orderBy("file", "function", "line").toLocalIterator()]
    return "\n".join(["# Coverage gaps", "", "| File | Function | Line | Content |", "| --- | --- | --- | --- |", *rows]) + "\n"
