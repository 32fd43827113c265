"""Fill-in-middle: texts rearranged as prefix, suffix and middle by DuckDB over Arrow batches.

Each batch is registered as a relation and one SQL statement cuts, arranges and returns it as Arrow,
so no row passes through Python code. Where a text is cut depends on its id and the seed alone, not
on the task, so that a repeated task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import released, row_slices

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text in one relation.
SLICE_BYTES = 4_000_000

_RESTORE = f"""CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN split_part(substr(output, {len(PREFIX) + 1}), '{SUFFIX}', 1) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{SUFFIX}', 2), '{MIDDLE}', 1)
  ELSE split_part(split_part(output, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(output, '{MIDDLE}', 2) || split_part(substr(output, {len(SUFFIX) + 1}), '{PREFIX}', 1) END"""

# one statement for a batch: units, then the digest's numbers, then the cuts, then the text
_ARRANGE = rf"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256($seed || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch
), r AS (
  SELECT doc_id, text, units, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS d FROM u
), c AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR d[3] % 100 >= $rate THEN 'plain' WHEN d[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM r
), p AS (
  SELECT doc_id, n, form, text, array_to_string(list_slice(units, 1, low), '') AS prefix, array_to_string(list_slice(units, low + 1, high), '') AS middle, array_to_string(list_slice(units, high + 1, n), '') AS suffix FROM c
), o AS (
  SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('{PREFIX}', prefix, '{SUFFIX}', suffix, '{MIDDLE}', middle) ELSE concat('{SUFFIX}', suffix, '{PREFIX}', prefix, '{MIDDLE}', middle) END AS output FROM p
)
"""


def _steps(sql: str, text_column: int, **values):
    """The Arrow step that runs ``sql`` over each slice of a batch, registered as ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = duckdb.connect(config={"threads": "1"})
        base.execute("SET enable_external_access = false")
        try:
            for batch in batches:
                for part in row_slices(batch, text_column, SLICE_BYTES):
                    base.register("batch", pa.Table.from_batches([part]))
                    reader = base.sql(sql, params=values or None).to_arrow_reader(4096)
                    yield from reader
                    base.unregister("batch")
        finally:
            base.close()

    return released(run)


def arrange(df: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, with_restored: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` (and ``restored``) of every row.

    ``rate`` of a hundred texts are rearranged, of these ``spm`` of a hundred with the suffix first;
    the lengths count code points and are null where the form is plain. A null text counts as empty
    and is plain with n = 0, as is a text that holds a marker; a null id is cut as the empty id.
    Rows of equal id and text have equal results, repeated rows stay rows of their own, extra
    columns are ignored whatever their names, an empty table gives no rows, and a long text is
    a slice of its own.
    """
    sql = _ARRANGE + (f"SELECT doc_id, n, form, prefix_chars, middle_chars, output, {_RESTORE} AS restored FROM o" if with_restored else "SELECT * FROM o")
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string" + (", restored string" if with_restored else "")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_steps(sql, 1, seed=str(seed), rate=rate, spm=spm), schema)


def restore(df: DataFrame) -> DataFrame:
    """``doc_id, text``: the exact texts of arranged rows ``doc_id, form, output``; a null output has a null text."""
    rows = df.select(F.col("doc_id").cast("long"), F.col("form").cast("string"), F.col("output").cast("string"))
    return rows.mapInArrow(_steps(f"SELECT doc_id, {_RESTORE} AS text FROM batch", 2), "doc_id long, text string")


def fill_digests(df: DataFrame) -> DataFrame:
    rows = arrange(df, with_restored=True)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The query's rows in SQL of its own: lines by splitting, cuts by their numbers of code points.
FILL_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, list_transform(string_split(x, chr(10)), lambda s: length(s) + 1) AS z, ends_with(x, chr(10)) OR x = '' AS closed FROM t),
n AS (SELECT *, (len(z) - closed::INT)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS a, ('0x' || h[9:16])::BIGINT AS b, ('0x' || h[25:32])::BIGINT AS f FROM l),
k AS (SELECT *, least(a % (n + 1), b % (n + 1)) AS i, greatest(a % (n + 1), b % (n + 1)) AS j, x = '' OR x LIKE '%<P>%' OR x LIKE '%<S>%' OR x LIKE '%<M>%' AS plain FROM n),
c AS (SELECT *, least(length(x), coalesce(list_sum(z[1:i]), 0))::BIGINT AS p, least(length(x), coalesce(list_sum(z[1:j]), 0))::BIGINT AS q FROM k)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN f % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN p END AS prefix_chars, CASE WHEN NOT plain THEN q - p END AS middle_chars,
  sha256(CASE WHEN plain THEN x WHEN f % 100 < 50 THEN '<S>' || substr(x, q + 1) || '<P>' || substr(x, 1, p) || '<M>' || substr(x, p + 1, q - p)
    ELSE '<P>' || substr(x, 1, p) || '<S>' || substr(x, q + 1) || '<M>' || substr(x, p + 1, q - p) END) AS output_sha256, sha256(x) AS restored_sha256
FROM c
"""
