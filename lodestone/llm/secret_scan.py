"""Secrets in texts: every rule in one automaton, one pass over the bytes.

The rules' expressions, read backwards, become one minimal deterministic automaton that may begin
anywhere. A single pass from the last byte to the first then marks where a match of each rule
begins; an automaton of the rule alone follows a marked match to its end. Matches of a rule are the
leftmost longest ones that don't overlap.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.automata import Automaton, backwards, determinise, parse
from lodestone.llm.common import byte_column, released, row_slices


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body``; a match counts if it has ``least`` bytes and its body ``least_body``."""

    kind: str
    body: str
    head: str = ""
    least: int = 0
    least_body: int = 0
    fold_head: bool = False


#: The base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", least_body=6, fold_head=True),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
)

#: Kinds that the method adds: issuers' marked keys, signed tokens and private keys.
ADDED_RULES = (
    Rule("private", r"-----BEGIN( [A-Z0-9]+)* PRIVATE KEY-----"),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)

#: Bytes of text scanned at once, bytes of a lane, and lanes below which arrays no longer pay.
SLICE_BYTES, LANE_BYTES, FEW_LANES = 4_000_000, 1_000, 12

_SPANS = "struct<rule:int,kind:string,start:long,end:long>"


class SecretScanner:
    """The compiled rules; small, and sent to tasks with their code."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [("cat", [parse(r.head, r.fold_head), parse(r.body)]) for r in rules]
        self.starts: Automaton = determinise([backwards(t) for t in trees], anywhere=True)
        self.whole = [determinise([t]) for t in trees]
        self.heads = [determinise([parse(r.head, r.fold_head)]) if r.head else None for r in rules]
        n_classes = self.starts.step.shape[1]
        self.table = (self.starts.step * n_classes).ravel().astype(np.min_scalar_type(self.starts.step.size))
        self.marks = np.repeat(self.starts.accepts, n_classes)
        self.resets = self.starts.resets()

    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each byte of the texts ``data[offsets[i]:offsets[i + 1]]`` the rules, as bits, of which a match begins there.

        Texts are cut into lanes before bytes after which no rule is under way, and all lanes go one
        byte to the left at a time; the last few long ones go alone.
        """
        low, high = int(offsets[0]), int(offsets[-1])
        codes = self.starts.classes[data[low:high]]
        cuts = np.flatnonzero(self.resets[data[low:high]])
        at = np.searchsorted(cuts, np.arange(LANE_BYTES, high - low, LANE_BYTES))
        edges = np.unique(np.concatenate([offsets - low, cuts[at[at < len(cuts)]]]))
        ends, lengths = edges[1:], np.diff(edges)
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[order], lengths[order]
        state, out = np.zeros(len(ends), self.table.dtype), np.zeros(high - low, self.table.dtype)
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        done = 0
        for n in live.tolist():
            if n < FEW_LANES:
                break
            here = ends[:n] - (done + 1)
            moved = self.table[state[:n] + codes[here].astype(self.table.dtype)]
            state[:n] = moved
            out[here] = moved
            done += 1
        table = None
        for lane in np.flatnonzero(lengths > done).tolist():
            table = table or self.table.tolist()
            end = int(ends[lane]) - done
            begin, s, path = int(ends[lane] - lengths[lane]), int(state[lane]), []
            for c in codes[begin:end][::-1].tobytes():
                s = table[s + c]
                path.append(s)
            out[begin:end] = np.array(path, self.table.dtype)[::-1]
        return self.marks[out]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its ``(start, rule, end)`` in code points, by start and then rule."""
        marked = self.begins(data, offsets)
        low = int(offsets[0])
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        hit = np.flatnonzero(marked)
        if not len(hit):
            return found
        # code points before each byte, counted from the slice's first
        points = np.concatenate([[0], np.cumsum((data[low : int(offsets[-1])] & 0xC0) != 0x80)])
        owner = np.searchsorted(offsets, hit + low, side="right") - 1
        for row in np.unique(owner).tolist():
            begin, end = int(offsets[row]), int(offsets[row + 1])
            text, mine = data[begin:end].tobytes(), hit[owner == row]
            base = points[begin - low]
            for k in range(len(self.rules)):
                places = (mine[(marked[mine] >> k & 1) == 1] + low - begin).tolist()
                for start, stop in self._matches(k, text, places):
                    found[row].append((int(points[begin - low + start] - base), k, int(points[begin - low + stop] - base)))
            found[row].sort()
        return found

    def _matches(self, k: int, text: bytes, places: list[int]) -> Iterator[tuple[int, int]]:
        rule, at = self.rules[k], 0
        while at < len(places):
            start = places[at]
            stop = self.whole[k].longest(text, start, len(text))
            body = self.heads[k].longest(text, start, stop) if self.heads[k] else start
            if stop - start >= rule.least and stop - body >= rule.least_body:
                yield start, stop
            at = bisect_left(places, stop, at + 1)


def scan(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: each row's matches as ``array<struct<rule, kind, start, end>>`` by start, then rule.

    Positions count code points, the end is exclusive. A null or empty text has no spans, repeated
    rows and ids are scanned each, ties of start go by rule, extra columns are ignored whatever
    their names, and an empty table gives no rows. Texts may have any length: a slice is one text or
    some megabytes of short ones. ``rules`` may have at most 62 rules; an empty match is none.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules fit one automaton")
    scanner = SecretScanner(tuple(rules))
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("rule", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part in row_slices(batch, 1, SLICE_BYTES):
                data, offsets = byte_column(part.column(1))
                rows = [[{"rule": k, "kind": kinds[k], "start": s, "end": e} for s, k, e in spans] for spans in scanner.spans(data, offsets)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"doc_id long, spans array<{_SPANS}>")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row (see scan)."""
    found = scan(df)
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))
    of = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    counts = [of(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _sql_rule(kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind in DuckDB: places from the lengths of the texts between matches and of the matches."""
    return f"""
SELECT doc_id, row_id, '{kind}' AS kind, s AS start, s + length(m) AS stop, m FROM (
  SELECT doc_id, row_id, unnest(hits) AS m, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))) AS s
  FROM (SELECT doc_id, row_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS parts FROM t WHERE regexp_matches(text, '{pattern}'))) WHERE {keep}"""


_WORDS = "(" + "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_HEAD = _WORDS + """["'']?\\x20*[:=]\\x20*["'']?"""
_KINDS = "[" + ", ".join(f"'{r.kind}'" for r in BASE_RULES + ADDED_RULES) + "]"

SCAN_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({" UNION ALL ".join([
    _sql_rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_HEAD}', '')) >= 6"),
    _sql_rule("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    _sql_rule("hex", "[0-9a-f]{24,}", "true"),
    _sql_rule("private", "-----BEGIN( [A-Z0-9]+)* PRIVATE KEY-----", "true"),
    _sql_rule("forge", "gh[oprsu]_[A-Za-z0-9]+", "length(m) >= 40"),
    _sql_rule("chat", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 20"),
    _sql_rule("cloud", "AIza[A-Za-z0-9_-]+", "length(m) >= 39"),
    _sql_rule("signed", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "length(m) >= 40"),
])}),
n AS (SELECT *, list_position({_KINDS}, kind) AS k, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS entry FROM a),
g AS (SELECT row_id, count_if(k = 1) AS n_assign, count_if(k = 2) AS n_access, count_if(k = 3) AS n_hex,
  coalesce(string_agg(entry, ',' ORDER BY start, k) FILTER (k <= 3), '') AS base, string_agg(entry, ',' ORDER BY start, k) AS spans FROM n GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (row_id)
"""
