"""I-Match fingerprints: hashes of a document's mid-frequency terms over randomised lexicon subsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WS_CLASS, partitions_for

#: Lexicon: terms found in at least LOW and at most HIGH of all documents (an idf from ln(1/HIGH) to
#: ln(1/LOW)). Hence it has at most (mean distinct terms a document) / LOW terms, at any corpus size.
LOW, HIGH = 0.0005, 0.05
#: Each of SUBSETS random orders of the lexicon gives nested subsets, a half, a quarter, ... of it. Of a
#: document with about 2**k lexicon terms, those of shares 2**-(k-1) to 2**-(k+1) are hashed (LEVELS).
SUBSETS, LEVELS = 32, 3
CACHE_TERMS = 300_000

_U = np.uint64


def terms_of(text: str) -> list[bytes]:
    """Distinct terms: runs of non ASCII white space, A-Z lower-cased."""
    return list(set(text.encode("utf-8", "surrogatepass").lower().split()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


_SEEDS = _mix(np.arange(1, 1 + SUBSETS, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _TermHashes(dict):
    def __missing__(self, term: bytes) -> int:
        value = self[term] = xxhash.xxh64_intdigest(term, seed=42)
        return value


_hashes = _TermHashes()


class Fingerprinter:
    """``lexicon``: sorted 64-bit hashes of the terms in the band."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon
        self._known = set(lexicon.tolist())

    def fingerprint(self, text: str) -> str:
        """Hex: first level, hash of all terms, then sixteen bits a subset, 0000 where it has no term.

        A document without any lexicon term is taken by all its terms, one without terms is all 0.
        The sorted distinct terms of a subset are folded into one hash by a sum, whose order is
        immaterial, and a final mix.
        """
        if len(_hashes) > CACHE_TERMS:
            _hashes.clear()
        found = list(map(_hashes.__getitem__, terms_of(text)))
        h = np.array([x for x in found if x in self._known] or found, _U)
        h.sort()
        first = max(0, round(float(np.log2(max(1, len(h))))) - 1)
        sums = np.zeros((LEVELS, SUBSETS), _U)
        for at in range(0, len(h), 1024):
            order = _mix(h[at : at + 1024, None] ^ _SEEDS)
            value = _mix(order)
            for k in range(LEVELS):
                sums[k] += np.where(order <= _U((2**64 - 1) >> (first + k)), value, _U(0)).sum(axis=0, dtype=_U)
        whole = _mix(h.sum(dtype=_U, keepdims=True)) if len(h) else np.zeros(1, _U)
        bits = np.where(sums == 0, 0, (_mix(sums) >> _U(48)) | _U(1))
        return np.concatenate([np.array([first], _U), whole >> _U(48), bits.ravel()]).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """From 0 to 1: 1 for equal fingerprints, else the share of the documents' subset hashes that agree.

    Subsets empty in a document don't count for it. The share is taken at the level, hashed for
    both, at which the number of subsets with a term is nearest to three fifths; a hash then mostly
    stands for one or two terms. Documents without a common level differ in size by far: 0.
    """
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f), ">u2") for f in (a, b))
    low, high = max(x[0], y[0]), min(x[0], y[0]) + LEVELS
    if low >= high:
        return 0.0
    x, y = (f[2:].reshape(LEVELS, SUBSETS)[int(low) - int(f[0]) : int(high) - int(f[0])] for f in (x, y))
    at = int(np.argmin(np.abs(((x != 0) | (y != 0)).sum(axis=1) - 0.6 * SUBSETS)))
    held = (x[at] != 0).sum() + (y[at] != 0).sum()
    return float(2 * ((x[at] == y[at]) & (x[at] != 0)).sum() / held) if held else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fit_lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Hashes of the terms whose document frequency, over every row, lies in the band."""
    total = docs.count()
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashes = F.array_distinct(F.transform(F.array_remove(F.split(lowered, WS_CLASS), ""), lambda w: F.xxhash64(w)))
    counted = docs.select(F.explode(hashes).alias("term")).groupBy("term").count()
    band = counted.where((F.col("count") >= max(1, low * total)) & (F.col("count") <= high * total)).select("term")
    return np.sort(np.array([r[0] for r in band.toLocalIterator()], np.int64).view(_U))


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``part, guest, doc_id, text`` so that, within a part sorted by (guest, descending id,
    text), each own row is followed by its next one; the part's last row by a guest from the next part.

    Parts are ranges of the id between approximate quantiles; the driver sees one id a part.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    n = partitions_for(docs)
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    ends = rows.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))  # at most a number a part

    def parts(ids: np.ndarray) -> np.ndarray:
        """Ids above a bound lie in a later range; parts count downwards from the largest ids."""
        return len(ends.value) - np.searchsorted(ends.value, ids)

    @F.arrow_udf("long")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(parts(ids.to_numpy(zero_copy_only=False)), pa.int64())

    tops = rows.groupBy(part("doc_id").alias("p")).agg(F.max("doc_id").alias("top")).orderBy("p").toArrow()  # one row a part
    held, heads = (tops[c].to_numpy() for c in ("p", "top"))
    order = rows.sparkSession.sparkContext.broadcast((held, heads))

    @F.arrow_udf("array<long>")
    def visited(ids: pa.Array) -> pa.Array:
        """A row's own part and, for those of its largest id, the part before it (the last for the first)."""
        held, heads = order.value
        ids = ids.to_numpy(zero_copy_only=False)
        own = parts(ids)
        at = np.searchsorted(held, own)
        twice = heads[at] == ids
        starts = np.concatenate([[0], np.cumsum(1 + twice)])
        out = np.repeat(own, 1 + twice)
        out[starts[1:][twice] - 1] = held[at[twice] - 1]
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out, pa.int64()))

    visits = visited("doc_id")
    return (
        rows.select(F.posexplode(visits).alias("guest", "part"), "doc_id", "text")
        .repartition(n, "part")
        .sortWithinPartitions("part", "guest", F.desc("doc_id"), "text")
    )


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The next document has the next smaller id (after the smallest: the largest; rows with one id
    follow by text; a null id counts as the smallest). Null texts are empty. A table of one row is
    its own next. Other columns are ignored.
    """
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(fit_lexicon(docs, low=low, high=high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter(shared.value)
        before, done = None, None
        for batch in batches:
            out = []
            for guest, part, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if guest and done == part:
                    continue  # of several guests only the first is next
                print_ = printer.fingerprint(text)
                if before is not None:
                    own_id, own, own_print = before
                    changed = edited(own, text)
                    changed_print = printer.fingerprint(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), sha, own_print, changed_print, likeness(own_print, changed_print), likeness(own_print, print_)))
                before = None if guest else (None if doc_id == -(2**63) else doc_id, text, print_)
                done = part if guest else done
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_following(docs).mapInArrow(run, _OUT)
