"""Periodic runs of words in linear time, by comparisons alone.

The words are the letters of a general ordered alphabet: they are only compared, never hashed or
numbered, and no suffix structure is built. A run is a maximal stretch that repeats its first words
with a smallest period. In one of the two orders of the alphabet, each place where a run's least
rotation begins has that rotation as its longest Lyndon word, so the longest Lyndon words of all
places, with how far each matches on behind itself, hold every run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WS_CLASS, let, released, row_slices

#: A run's least length in words, and its least exponent.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text worked on before rows are handed on.
SLICE_BYTES = 4_000_000

_RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_stretches(words: list, descending: bool, factor: int) -> dict[int, list[tuple[int, int]]]:
    """By period p: ``(i, end)`` for each i whose longest Lyndon word is ``words[i:i + p]`` and that goes on with
    period p up to ``end``, over ``factor * p`` words behind it. The end of the words is less than any word.

    ``after[i]`` is the next place with a smaller suffix (where the longest Lyndon word at i ends) and
    ``before[i]`` the last place with one; ``match_after`` and ``match_before`` say how many words the two suffixes
    have in common. Places are taken from the left and the last ones of smaller suffixes walked
    back, as on a stack. Matches are reused in two ways. Along one walk two neighbours on the stack
    have a known common length, so a match is never begun anew. And the match that reaches furthest,
    say up to ``reach`` with a shift of ``shift``, tells the result of each later place below
    ``reach``: that of the place a shift before, unless that match came up to ``reach`` too, when it is
    continued there. So every successful comparison is of a new word at ``reach``, and the others
    are at most two a place: time is linear in the number of words.
    """
    n = len(words)
    after, before, match_after, match_before = [n] * n, [-1] * n, [0] * n, [0] * n
    found: dict[int, list[tuple[int, int]]] = {}
    reach = shift = 0
    for i in range(1, n):
        p, match = i - 1, 0
        if i < reach:
            room, twin, settled = reach - i, i - shift, False
            while True:
                q = p - shift
                if after[q] == twin:
                    match = match_after[q]
                    if match >= room:
                        match = room
                        break
                    after[p], match_after[p] = i, match
                    if match > factor * (i - p):
                        found.setdefault(i - p, []).append((p, i + match))
                    p = before[p]
                else:
                    match = match_before[twin]
                    if match >= room:
                        match = room
                        break
                    before[i], match_before[i] = p, match
                    settled = True
                    break
            if settled:
                continue
        while True:
            at = i + match
            while at < n and words[p + match] == words[at]:
                match += 1
                at += 1
            reach, shift = at, i - p
            if at < n and (words[p + match] > words[at] if descending else words[p + match] < words[at]):
                before[i], match_before[i] = p, match
                break
            while True:  # the suffix at p is the greater one, and so is each that shares more with it
                after[p], match_after[p] = i, match
                if match > factor * (i - p):
                    found.setdefault(i - p, []).append((p, at))
                shared, p = match_before[p], before[p]
                if p < 0 or shared <= match:
                    break
            if p < 0:
                break
            if shared < match:
                before[i], match_before[i] = p, shared
                break
    return found


def runs_of(words: list, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of at least ``least_length`` words and ``least_exponent`` periods, in order.

    The words read from the left give where each run ends; only if there is any stretch they are
    read from the right too, which gives where it starts. Two runs of one period have less than a
    period in common, so ends and starts meet in order. ``least_exponent`` must be 3 or more: then
    both readings show over two periods of the run.
    """
    if least_exponent < 3:
        raise ValueError("runs are found from an exponent of 3")
    ends = [lyndon_stretches(words, descending, least_exponent - 2) for descending in (False, True)]
    if not any(ends):
        return []
    back, n = words[::-1], len(words)
    starts: dict[int, list[tuple[int, int]]] = {}
    for descending in (False, True):
        for period, stretches in lyndon_stretches(back, descending, least_exponent - 2).items():
            starts.setdefault(period, []).extend((n - end, n - i) for i, end in stretches)
    found = set()
    for period in starts:
        heads = sorted(starts[period])
        for place, end in {stretch for side in ends for stretch in side.get(period, ())}:
            at = bisect_right(heads, (place, n + 1)) - 1
            if at >= 0 and heads[at][1] > place + period:
                length = end - heads[at][0]
                if length >= max(least_length, least_exponent * period):
                    found.add((heads[at][0], length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep) if k]


def find_runs(df: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: runs as ``array<struct<start, length, period>>`` by start, then period.

    Words are separated by ASCII white space and numbered from 0; ``collapsed`` is the text of the
    words that no run repeats, joined by one space. A null text, an empty one and one of white space
    have no runs and an empty ``collapsed``. Repeated rows and ids are worked on each, extra columns are ignored
    whatever their names, an empty table gives no rows; a text of any length is one list of words.
    """
    if least_exponent < 3:
        raise ValueError("runs are found from an exponent of 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in row_slices(batch, 1, SLICE_BYTES):
                runs, texts = [], []
                for text in part.column(1).cast(pa.large_binary()).to_pylist():
                    words = text.split() if text else []  # bytes are split at ASCII white space
                    mine = runs_of(words, least_length, least_exponent)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                    texts.append(b" ".join(collapsed(words, mine)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"doc_id long, runs {_RUNS}, collapsed string")


def planted(df: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the texts, by the crc32 of the id, with a periodic end of their own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", WS_CLASS), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(at, " ")).otherwise("")

    return df.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, periodic)).otherwise(F.col("text")).alias("text"))


def run_digests(df: DataFrame) -> DataFrame:
    """Runs of ``df`` as the registered query returns them (see find_runs)."""
    found = find_runs(df)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.short")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
