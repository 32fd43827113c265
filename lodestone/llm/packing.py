"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import released
from lodestone.llm.tokens import encoder_for, tokenizer_file

CAPACITY, END_ID = 2048, 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, for dense layers and for attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens gathered before a block is packed.
BLOCK_TOKENS = 4_000_000

_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)`` of items with the given token counts.

    Whole multiples of the capacity fill sequences of their own. What is left is dealt in
    descending length to as few sequences as can hold it, each item to the one of lowest cost that
    has room; where none has room for all of it, the roomiest takes what it can and the rest
    follows. So at most the last sequence of a block is partly empty.
    """
    pieces, sequence = [], 0
    for item in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[item]) - capacity + 1, capacity):
            pieces.append((int(item), start, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    room = np.full(-(-int(rest.sum()) // capacity), capacity, np.int64)
    if len(room):
        room[-1] = int(rest.sum()) - capacity * (len(room) - 1)
    cost = LINEAR * (capacity - room) + 0.0
    filled = np.zeros(len(room), np.int64)
    for item in np.argsort(-rest, kind="stable"):
        left, start = int(rest[item]), int(lengths[item] - rest[item])
        while left:
            fits = room >= left
            at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[at]))
            pieces.append((int(item), start, n, sequence + at, int(filled[at])))
            room[at] -= n
            filled[at] += n
            cost[at] += LINEAR * n + QUADRATIC * n * n
            left -= n
            start += n
    return pieces


def pack_documents(
    df: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of every row.

    A document is its ids and then ``end_id`` (null and empty texts: only that). Each task packs
    its own rows in blocks of about BLOCK_TOKENS tokens, so no text moves and memory is bounded;
    sequence_id is unique over tasks (task number, then a running number). Repeated rows and
    repeated ids are documents of their own; extra columns are ignored; an empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = encoder_for(shared.value), TaskContext.get().partitionId() << 36
        names, docs, tokens = [], [], 0

        def block():
            nonlocal base, names, docs, tokens
            lengths = np.array([len(d) // 4 for d in docs], np.int64)
            pieces = pack_lengths(lengths, capacity)
            for at in range(0, len(pieces), 4096):
                item, start, length, sequence, offset = map(np.array, zip(*pieces[at : at + 4096]))
                ids = [docs[i][4 * s : 4 * (s + n)] for i, s, n in zip(item.tolist(), start.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in item], pa.int64()), pa.array(start), pa.array(length), pa.array(lengths[item]), pa.array(sequence + base), pa.array(offset), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            base += max(p[3] for p in pieces) + 1
            names, docs, tokens = [], [], 0

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode_each(batch.column(1))):
                names.append(name)
                docs.append(ids + end)
                tokens += len(docs[-1]) // 4
                if tokens >= BLOCK_TOKENS:
                    yield from block()
        if docs:
            yield from block()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), _PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def packed(df: DataFrame) -> DataFrame:
    return piece_digests(pack_documents(df, tokenizer_file()))
