"""Byte-level BPE: merges folded by higher-order functions over the bytes of distinct words.

Words that occur in the table's most frequent chunks are folded once for the whole table and sent
to all tasks (at most COMMON of them); within a task each other word is folded once. A first step
deals texts into chunks (cut before a space that a non-space follows, where no match of the pattern
can cross) and the chunks into words, the pattern's matches, and hands on each new word a single
time, as a string whose characters stand for its bytes (Latin-1). The fold looks ranks of pairs up
in literal tables; a last step puts the ids of words back into the texts' order and, if asked,
decodes them. No text leaves its task, so only counts of chunks are shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from lodestone.llm.common import array_literal, let, partitions_for, persist_table, released, row_slices

#: Words of more bytes are folded with a heap outside Spark: the array fold is quadratic in a word.
LONG_WORD = 8192
#: Chunks and words of a task remembered before both steps forget them, and words handed on in one row.
REMEMBERED, REMEMBERED_WORDS, WORDS_A_ROW = 200_000, 300_000, 2000
#: Bytes of texts, or of their chunks' numbers, that a step holds as Python objects and hands on at once.
SLICE = 1 << 21
#: Chunks, at most, whose words are folded for the whole table; the least they occur; their most characters.
COMMON, LEAST_COMMON, LONGEST_COMMON = 500_000, 4, 48
#: Bits of an id, a place in a word and a pair's rank in a piece of the fold's state, and what stands for no rank.
BITS = 20
NONE = 1 << BITS

_rough = re.compile(r" (?=\s|$)")
_cut = re.compile(r" (?=\S)")


def ranks_file(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    import public_tokenizers

    lines = Path(public_tokenizers.path(name)).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


# --- the fold -------------------------------------------------------------------------------------


def displace(left: np.ndarray, right: np.ndarray, rank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shift, owner and rank tables of a sparse matrix: row ``a`` has its column ``b`` at place ``shift[a] + b``.

    Rows are shifted, the fullest first, so that no two entries share a place; ``owner`` says whose it is.
    """
    order = np.lexsort((right, left))
    left, right, rank = left[order], right[order], rank[order]
    rows, starts, counts = np.unique(left, return_index=True, return_counts=True)
    used = np.zeros(3 * size + 8 * len(left) + 4096, bool)
    shift, place, low, step = np.zeros(size, np.int64), np.zeros(len(left), np.int64), 0, 512
    for r in np.argsort(-counts, kind="stable").tolist():
        cols = right[starts[r] : starts[r] + counts[r]]
        while used[low]:
            low += 1
        at = low - int(cols[0])
        if len(cols) > 1:
            while True:
                free = ~used[at + cols[0] : at + cols[0] + step]
                for c in cols[1:].tolist():
                    free &= ~used[at + c : at + c + step]
                hit = int(free.argmax())
                if free[hit]:
                    at += hit
                    break
                at += step
        used[at + cols] = True
        shift[rows[r]], place[starts[r] : starts[r] + counts[r]] = at, at + cols
    owner, ranks = np.full(int(place.max(initial=0)) + 1, -1), np.full(int(place.max(initial=0)) + 1, NONE)
    owner[place], ranks[place] = left, rank
    return shift, owner, ranks


class RankTables:
    """Literal tables of the ranks: of single bytes, and of pairs of pieces by their ids."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NONE - 1:
            raise ValueError(f"ids must be below {NONE - 1}")
        pairs = [
            (a, b, rank)
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None
        ]
        left, right, rank = np.array(pairs or np.zeros((0, 3)), np.int64).T
        shift, owner, rank = displace(left, right, rank, max(ranks.values()) + 1)
        self.single = array_literal(spark, np.array([ranks[bytes([i])] for i in range(256)]), "int")
        self.shift, self.owner = array_literal(spark, shift, "int"), array_literal(spark, owner, "int")
        self.ranks = array_literal(spark, rank, "bigint")

    def rank(self, a: Column, b: Column) -> Column:
        """Rank, and id, of the merged pair; NONE for a pair that is no piece or with a null."""
        at = F.get(self.shift, a) + b
        return F.when(F.get(self.owner, at) == a, F.get(self.ranks, at)).otherwise(F.lit(NONE).cast("long"))


def fold_word(word: Column, tables: RankTables) -> Column:
    """Ids of one word: from its bytes, ever the leftmost pair of least rank is merged.

    Each piece of the state is one number: the rank of its pair with the next piece, its place, its
    id, from the highest bits down; so the least number is the pair to merge. A stand-in before the
    first piece spares conditions; its pairs have no rank.
    """
    low = F.lit((1 << 2 * BITS) - 1).cast("long")
    id_of = lambda x: x.bitwiseAND(F.lit(NONE - 1)).cast("int")
    ranked = lambda rank: F.shiftleft(rank, 2 * BITS)
    placed = lambda x: x.bitwiseAND(F.lit((NONE - 1) << BITS).cast("long"))

    def merge(state: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            def joined(i: Column) -> Column:  # place of the pair's left piece, from 1
                rank = F.shiftright(least, 2 * BITS).cast("int")
                before, after = F.get(state, i - 2), F.get(state, i + 1)
                return F.concat(
                    F.slice(state, 1, i - 2),
                    F.array(
                        ranked(tables.rank(id_of(before), rank)).bitwiseOR(before.bitwiseAND(low)),
                        ranked(tables.rank(rank, id_of(after))).bitwiseOR(placed(least)).bitwiseOR(rank),
                    ),
                    F.slice(state, i + 2, F.size(state)),
                )

            return F.when(least >= F.lit(NONE << 2 * BITS), state).otherwise(let(F.array_position(state, least).cast("int"), joined))

        return let(F.array_min(state), at)

    def fold(codes: Column) -> Column:
        pairs = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: ranked(tables.rank(a, b)).bitwiseOR(a))
        start = F.transform(pairs, lambda x, i: x.bitwiseOR(F.shiftleft(i.cast("long"), BITS)))
        steps = F.sequence(F.lit(3), F.size(codes))
        return F.aggregate(steps, start, merge, lambda state: F.transform(F.slice(state, 2, F.size(state)), id_of))

    codes = F.transform(F.split(word, ""), lambda c: F.get(tables.single, F.ascii(c)))
    return let(F.concat(F.array(F.lit(NONE - 1)), codes), fold)


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, in n log n."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# --- around the fold --------------------------------------------------------------------------------

_GATHERED = "doc_id long, refs binary, words array<string>, forget boolean, forget_words boolean, chunks binary, lengths binary"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("refs", pa.binary()), ("words", pa.list_(pa.string())), ("forget", pa.bool_()), ("forget_words", pa.bool_()), ("chunks", pa.binary()), ("lengths", pa.binary())])


def _gatherer(pattern_: str, known: Callable[[], list[str]] = list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        match = regex.compile(pattern_)
        heads: dict[str, int] = {}
        bodies: dict[str, int] = {}
        words = {w: i for i, w in enumerate(known())}
        common = len(words)
        fresh: list[str] = []
        chunks: list[int] = []
        lengths: list[int] = []
        held: list[tuple] = []
        count, forget, forget_words = 0, False, False

        def meet(chunk: str, known: dict[str, int], text: str) -> int:
            nonlocal count
            # a known word that makes up a whole chunk is its only match
            found = [text] if text in words else match.findall(text)
            for w in found:
                if w not in words:
                    words[w] = len(words)
                    fresh.append(w)
            chunks.extend(map(words.__getitem__, found))
            lengths.append(len(found))
            known[chunk] = at = count
            count += 1
            return at

        def rows():
            nonlocal fresh, chunks, lengths, held, forget, forget_words
            out = []
            parts = [fresh[i : i + WORDS_A_ROW] for i in range(0, len(fresh), WORDS_A_ROW)] or [[]]
            for i, part in enumerate(parts):
                last = i == len(parts) - 1
                coded = [w.encode("utf-8", "surrogatepass").decode("latin-1") for w in part]
                out.append((None, None, coded, forget and i == 0, forget_words and i == 0, np.array(chunks, "<i4").tobytes() if last else b"", np.array(lengths, "<i4").tobytes() if last else b""))
            out += [(doc, refs, None, None, None, None, None) for doc, refs in held]
            fresh, chunks, lengths, held, forget, forget_words = [], [], [], [], False, False
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_FIELDS)], schema=_FIELDS)

        size = 0
        for part in (part for batch in batches for part in row_slices(batch, 1, SLICE)):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = text or ""
                parts = _cut.split(text) if _rough.search(text) else text.split(" ")
                head, rest = parts[0], parts[1:]
                refs = [heads[head] if head in heads else meet(head, heads, head)]
                try:
                    refs += map(bodies.__getitem__, rest)
                except KeyError:
                    refs = refs[:1]
                    refs += [bodies[c] if c in bodies else meet(c, bodies, " " + c) for c in rest]
                held.append((doc, np.array(refs, "<i4").tobytes()))
                size += len(refs)
                if size > 500_000:
                    yield rows()
                    size = 0
                if count > REMEMBERED:
                    if held:
                        yield rows()
                    heads.clear(), bodies.clear()
                    count, size, forget = 0, 0, True
                    if len(words) - common > REMEMBERED_WORDS:
                        words, forget_words = {w: i for i, w in enumerate(known())}, True
        if held:
            yield rows()

    return run


def _assembler(batches: Iterator[pa.RecordBatch], known: list[bytes] = [], pieces: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:  # noqa: B006
    words: list[bytes] = list(known)
    chunks: list[bytes] = []
    for batch in (part for batch in batches for part in row_slices(batch, batch.schema.get_field_index("refs"), SLICE)):
        names, ids = [], []
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        docs, refs, forget, forget_words = (col[n].to_pylist() for n in ("doc_id", "refs", "forget", "forget_words"))
        for i in range(batch.num_rows):
            if refs[i] is not None:
                names.append(docs[i])
                ids.append(b"".join(map(chunks.__getitem__, np.frombuffer(refs[i], "<i4").tolist())))
                continue
            if forget[i]:
                chunks = []
            if forget_words[i]:
                del words[len(known) :]
            folded = col["ids"][i].values
            if folded is not None and len(folded):
                flat = folded.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                ends = (np.cumsum([0, *folded.value_lengths().to_pylist()]) * 4).tolist()
                words += [flat[a:b] for a, b in zip(ends, ends[1:])]
            at, flat_words = 0, np.frombuffer(col["chunks"][i].as_py(), "<i4").tolist()
            for n in np.frombuffer(col["lengths"][i].as_py(), "<i4").tolist():
                chunks.append(words[flat_words[at]] if n == 1 else b"".join([words[w] for w in flat_words[at : at + n]]))
                at += n
        out = [pa.array(names, pa.int64()), pa.array(ids, pa.binary())]
        if pieces is None:
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids"])
        else:
            yield pa.RecordBatch.from_arrays([*out, pa.array(_pieced(ids, pieces), pa.binary())], names=["doc_id", "ids", "decoded"])


def _pieced(ids: list[bytes | None], pieces: list[bytes]) -> list[bytes | None]:
    """The binary pieces of ids, one after another."""
    get = pieces.__getitem__
    return [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in ids]


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def _latin(word: str) -> str:
    return word.encode("utf-8", "surrogatepass").decode("latin-1")


def common_words(rows: DataFrame, ranks: dict[bytes, int], pattern_: str, tables: RankTables) -> tuple[list[str], list[bytes]]:
    """Words known to every task, and their ids: the pieces themselves, and words of the most frequent chunks.

    Chunks are counted over all rows; those of the highest counts, COMMON at most, give their words,
    which are folded once. Which words these are changes no result.
    """
    import regex

    words = {w.decode("utf-8"): r for w, r in ranks.items() if _is_text(w)}
    counted = (
        rows.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("chunk"))
        .where(F.length("chunk").between(1, LONGEST_COMMON))
        .groupBy("chunk")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_COMMON)
    )
    counted = persist_table(counted.select("chunk", F.floor(4 * F.log2("n")).cast("int").alias("level")), "chunks")
    least, total = None, 0
    for level, n in sorted(map(tuple, counted.groupBy("level").count().collect()), reverse=True):
        if total + n > COMMON:
            break
        least, total = level, total + n
    chosen = [] if least is None else counted.where(F.col("level") >= least).select("chunk").toArrow()["chunk"].to_pylist()
    match = regex.compile(pattern_)
    new = list({w for c in chosen for w in match.findall(" " + c)}.difference(words))
    names, ids = list(words), [np.array([r], "<u4").tobytes() for r in words.values()]
    if new:
        table = rows.sparkSession.createDataFrame(pa.table({"at": np.arange(len(new)), "word": [_latin(w) for w in new]}))
        folded = table.repartition(partitions_for(rows)).select("at", fold_word(F.col("word"), tables).alias("ids")).toArrow()
        names += [new[i] for i in folded["at"].to_pylist()]
        lists = folded["ids"].combine_chunks()
        flat, ends = lists.flatten().to_numpy().astype("<u4").tobytes(), np.cumsum([0, *lists.value_lengths().to_pylist()]) * 4
        ids += [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return names, ids


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def encode(
    df: DataFrame, ranks: dict[bytes, int], pattern_: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``doc_id, ids`` of every row: the ids as little-endian unsigned 32-bit integers.

    With ``decoded`` a third column has the ids' binary pieces, one after another. Null and empty
    texts give no ids; strings of special tokens are ordinary text; repeated rows and ids stay rows
    of their own; extra columns are ignored. ``ranks`` must hold all single bytes.
    """
    spark = df.sparkSession
    tables, send = RankTables(spark, ranks), spark.sparkContext.broadcast
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words, ids = common_words(rows, ranks, pattern_, tables)
    known, known_ids, long_ranks = send(words), send(ids), send(ranks)
    pieces = send(_pieces(ranks)) if decoded else None
    gathered = rows.mapInArrow(released(_gatherer(pattern_, lambda: known.value)), _GATHERED)
    folded = F.transform("words", lambda w: F.when(F.length(w) <= LONG_WORD, fold_word(w, tables)))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _assembler(_completed(batches, long_ranks), known_ids.value, pieces and pieces.value)

    return gathered.withColumn("ids", folded).mapInArrow(released(assemble), "doc_id long, ids binary" + (", decoded binary" if decoded else ""))


def _completed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Words left unfolded for their length are folded with the heap."""
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        ids, words = batch.column(at), batch.column(batch.schema.get_field_index("words"))
        inner = ids.flatten() if ids.null_count < len(ids) else None
        if inner is not None and inner.null_count:
            whole = [
                None if x is None else [fold_bytes(w.encode("latin-1"), shared.value) if y is None else y for w, y in zip(ws, x)]
                for ws, x in zip(words.to_pylist(), ids.to_pylist())
            ]
            batch = batch.set_column(at, "ids", pa.array(whole, pa.list_(pa.list_(pa.int32()))))
        yield batch


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the binary pieces of its ids, one after another (null ids: null)."""
    shared, at = df.sparkSession.sparkContext.broadcast(_pieces(ranks)), df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array(_pieced(batch.column(at).to_pylist(), shared.value), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("decoded", BinaryType()))


def round_trip(df: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; a null or empty text has no ids and empty bytes."""
    size = F.expr("octet_length(ids) div 4").cast("long")
    return encode(df, ranks_file(), pattern(), decoded=True).select(
        "doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
