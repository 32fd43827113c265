"""URL filter: a trie over reversed host labels and path segments, longest rule first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the rules that op7 applies.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and where no ``://`` is."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Rules under their reversed host labels, then their whole path segments.

    The last segment of a rule's path is a prefix of the url's segment there. Of the rules that
    fit, the one with the most characters wins; of equally long ones that with the longer host,
    then a block before an allow.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            if path and not path.startswith("/"):
                raise ValueError(f"a rule's path starts with /: {path}")
            rank = (len(host) + len(path), len(host), verdict == "block")
            if path:
                *whole, last = path[1:].split("/")
                node = node.setdefault("path", {})
                for segment in whole:
                    node = node.setdefault("segments", {}).setdefault(segment, {})
                ends = node.setdefault("ends", {})
            else:
                ends, last = node.setdefault("any", {}), ""
            ends[last] = max(ends.get(last, (rank, "", "")), (rank, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """``(rule, verdict)`` of the winning rule."""
        best = None
        node = self.root
        segments = path[1:].split("/") if path else []
        for label in reversed(host.split(".")) if host else ():
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            found = [*node.get("any", {}).values()]
            at = node.get("path")
            for segment in segments:
                if at is None:
                    break
                found += [rule for last, rule in at.get("ends", {}).items() if segment.startswith(last)]
                at = at.get("segments", {}).get(segment)
            best = max([*found, *([best] if best else [])], default=None)
        return best and best[1:]


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; without a fitting rule, ``default``.

    A null url, or one without ``://``, has empty host and path and so no rule. Only the two
    columns are read; the trie is broadcast, its size bounded by the rules given.
    """
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hits = [match(*p) or (None, default) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[i] for x in y], pa.string()) for y in (parts, hits) for i in (0, 1))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


FILTER_SQL = """
WITH r(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT h.page_id, max({'n': length(r.host) + length(r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS best
      FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY 1)
SELECT h.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
