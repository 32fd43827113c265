"""Token ids as wavelet matrices: one compressed file per shard, with access, rank and select.

File: magic, five unsigned 32-bit numbers (tokens, documents, bit planes, bytes of the documents'
frame, crc32 of all that follows), then
- the documents' zstd frame: their ids (int64) and lengths (uint32);
- the rank directory, unsigned 32-bit: for each plane and block of BLOCK bytes the ones of the plane
  before the block; then, for each plane, all its ones; then, for each block, where its frame ends;
- one zstd frame for each block of each plane, most significant bit first, packed eight to a byte.
A look-up inflates only the blocks that it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import partitions_for, persist_table, released
from lodestone.llm.tokens import ChunkEncoder, encoder_for, tokenizer_file

MAGIC, HEAD = b"LWM2", struct.Struct("<4sIIIII")
#: Bytes of a plane in one block.
BLOCK = 8192
#: Tokens in one file, apart from a document that is longer by itself.
FILE_TOKENS, END_ID = 1_000_000, 0
#: Chunks in a generation of a worker's store; beside this step no other holds much of an executor.
STORE = 600_000

_FILES = "shard long, file long, n_docs long, n_tokens long, content binary"
_DOCS = "shard long, file long, doc_id long, at long, n_tokens long, ids binary"


def write_matrix(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    docs = pack(doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes())
    starts = np.arange(0, -(-len(ids) // 8), BLOCK)
    before, totals, frames = [], [], []
    for b in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << b)) != 0
        plane = np.packbits(one)
        ones = np.add.reduceat(np.bitwise_count(plane), starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        before.append(np.cumsum(ones) - ones)
        totals.append(int(ones.sum()))
        raw = plane.tobytes()
        frames += [pack(raw[i : i + BLOCK]) for i in starts.tolist()]
        a = np.concatenate([a.take(np.flatnonzero(~one)), a.take(np.flatnonzero(one))])  # by places: faster than by a mask, as fast as compress
    ends = np.cumsum([len(f) for f in frames])
    body = b"".join([docs, *(np.asarray(x, "<u4").tobytes() for x in (*before, totals, ends)), *frames])
    return HEAD.pack(MAGIC, len(ids), len(doc_ids), bits, len(docs), zlib.crc32(body)) + body


class WaveletMatrix:
    """A shard read from its file; blocks are inflated when they are looked into."""

    def __init__(self, content: bytes):
        magic, self.n, docs, self.bits, size, crc = HEAD.unpack_from(content) if len(content) >= HEAD.size else (None,) * 6
        if magic != MAGIC or zlib.crc32(memoryview(content)[HEAD.size :]) != crc:
            raise ValueError("not a whole wavelet matrix file")
        self.unpack = zstandard.ZstdDecompressor().decompress
        named = self.unpack(content[HEAD.size : HEAD.size + size])
        self.doc_ids = np.frombuffer(named, "<i8", docs)
        self.lengths = np.frombuffer(named, "<u4", docs, 8 * docs)
        self.width = -(-(-(-self.n // 8)) // BLOCK)  # blocks a plane
        at = HEAD.size + size
        self.before = np.frombuffer(content, "<u4", self.bits * self.width, at).reshape(self.bits, self.width)
        at += 4 * self.bits * self.width
        self.ones = np.frombuffer(content, "<u4", self.bits, at)
        self.zeros = self.n - self.ones.astype(np.int64)
        at += 4 * self.bits
        self.ends = [0, *np.frombuffer(content, "<u4", self.bits * self.width, at).tolist()]
        self.content, self.first = content, at + 4 * self.bits * self.width
        self.inflated: dict[int, np.ndarray] = {}

    def _frame(self, number: int) -> bytes:
        return self.unpack(self.content[self.first + self.ends[number] : self.first + self.ends[number + 1]])

    def _block(self, level: int, block: int) -> np.ndarray:
        number = level * self.width + block
        if number not in self.inflated:
            self.inflated[number] = np.frombuffer(self._frame(number), np.uint8)
        return self.inflated[number]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, byte = divmod(i // 8, BLOCK)
        if block == self.width:
            return int(self.ones[level])
        count = int(self.before[level, block])
        if byte or i % 8:
            bits = self._block(level, block)
            count += int(np.bitwise_count(bits[:byte]).sum())
            if i % 8:
                count += int(bits[byte] >> (8 - i % 8)).bit_count()
        return count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of that value in a plane."""
        before = self.before[level].astype(np.int64)
        if not bit:
            before = np.arange(self.width) * (8 * BLOCK) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        found = np.flatnonzero(np.unpackbits(self._block(level, block)) == bit)
        return block * 8 * BLOCK + int(found[k - before[block]])

    def _bit(self, level: int, i: int) -> int:
        block, byte = divmod(i // 8, BLOCK)
        return int(self._block(level, block)[byte]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = int(zeros) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        a, b = 0, end
        for level, zeros in enumerate(self.zeros):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (int(zeros) + x, int(zeros) + y) if token >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` among the first ``end`` ids (default: all)."""
        a, b = self._range(token, self.n if end is None else min(end, self.n))
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            zeros = int(self.zeros[level])
            i = self._select(level, 1, i - zeros) if i >= zeros else self._select(level, 0, i)
        return i

    def occurrences(self, token: int) -> list[int]:
        """Places of ``token``, ascending; what select gives for each, a plane at a time."""
        a, b = self._range(token, self.n)
        at = np.arange(a, b)
        for level in range(self.bits - 1, -1, -1) if len(at) else ():
            bit = token >> (self.bits - 1 - level) & 1
            at = np.flatnonzero(self._plane(level) == bit)[at - (int(self.zeros[level]) if bit else 0)]
        return at.tolist()

    def _plane(self, level: int) -> np.ndarray:
        packed = b"".join(self._frame(level * self.width + i) for i in range(self.width))
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n)

    def tokens(self) -> np.ndarray:
        """All ids in their order, undoing the planes from the last to the first."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = self._plane(level).view(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~one)] = a[: self.zeros[level]]
            up[np.flatnonzero(one)] = a[self.zeros[level] :] | a.dtype.type(1 << (self.bits - 1 - level))
            a = up
        return a


def _write(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder, end_id: int, shard: int) -> Iterator[pa.RecordBatch]:
    held, tokens, file = [], 0, 0

    def one_file():
        names, lengths, ids = map(np.concatenate, zip(*held))
        return pa.RecordBatch.from_pydict(
            {"shard": [shard], "file": [file], "n_docs": [len(names)], "n_tokens": [len(ids)], "content": pa.array([write_matrix(ids, names, lengths)], pa.binary())}
        )

    for batch in batches:
        names, at = batch.column(0).fill_null(-(2**63)).to_numpy(), 0
        for ids, ends in encoder.encode_column(batch.column(1)):
            ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            first, last = 0, len(ends) - 1
            while first < last:
                to = min(last, int(np.searchsorted(ends, ends[first] + FILE_TOKENS - tokens)))
                held.append((names[at + first : at + to], np.diff(ends[first : to + 1]), ids[ends[first] : ends[to]]))
                tokens += len(held[-1][2])
                first = to
                if tokens >= FILE_TOKENS:
                    yield one_file()
                    held, tokens, file = [], 0, file + 1
            at += last
    if held:
        yield one_file()


def write_files(df: DataFrame, tokenizer_json: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files ``shard, file, n_docs, n_tokens, content`` with the ids of all rows by ascending id.

    Rows are dealt by ranges of the id, so (shard, file) is their order. Every row gives its ids
    and then ``end_id`` (null and empty texts: only that); rows with one id follow one another by
    text; a null id comes first and is read back as null's stand-in, the least long. Files are
    written as rows of a table in the shared folder, which any executor can read.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write(batches, encoder_for(shared.value, STORE), end_id, TaskContext.get().partitionId())

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions_for(df), "doc_id").sortWithinPartitions("doc_id", "text")
    return persist_table(dealt.mapInArrow(released(run), _FILES), "wavelet")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, file, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            m = WaveletMatrix(content)
            ends, n = np.cumsum(m.lengths, dtype=np.int64), len(m.doc_ids)
            starts, places = ends - m.lengths, pa.array(np.append(0, 4 * ends), pa.int32())
            ids = pa.BinaryArray.from_buffers(pa.binary(), n, [None, places.buffers()[1], pa.py_buffer(m.tokens().astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard, np.int64)), pa.array(np.full(n, file, np.int64)), pa.array(m.doc_ids), pa.array(starts), pa.array(m.lengths.astype(np.int64)), ids],
                names=["shard", "file", "doc_id", "at", "n_tokens", "ids"],
            )


def _places(files: DataFrame) -> DataFrame:
    """``shard, file, before``: the ids of all files before each one."""
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    sizes = sizes.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return files.select("shard", "file", own.alias("own")).join(sizes, "shard").select("shard", "file", (F.col("shard_start") + F.col("own")).alias("before"))


def read_files(files: DataFrame, ids: Column | None = None, name: str = "ids") -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids``; start counts all ids before it.

    ``ids`` may be an expression of the column ids, called ``name``; it is evaluated where a file is
    read, so that only its result is moved.
    """
    docs = files.select("shard", "file", "content").mapInArrow(released(_read), _DOCS)
    docs = docs.select("shard", "file", F.nullif("doc_id", F.lit(-(2**63))).alias("doc_id"), "at", "n_tokens", (F.col("ids") if ids is None else ids).alias(name))
    return docs.join(_places(files), ["shard", "file"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", name)


def round_trip(df: DataFrame) -> DataFrame:
    return read_files(write_files(df, tokenizer_file()), F.crc32("ids"), "ids_crc32")
