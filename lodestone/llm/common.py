"""Helpers shared by the training-data operators: shared scratch tables, clean inputs, lets."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: ASCII white space, as the word rule ``[^\x20\x09-\x0D]+`` has it.
WS_CLASS = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local master (tests, a laptop) gets a temporary folder once; on a cluster
    that is an error, as executors would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the reread table (cuts lineage)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that nested lambdas see it evaluated once."""
    return F.transform(F.array(value), body)[0]


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The Arrow step ``step``, whose freed memory goes back to the system when its task ends.

    Spark keeps idle Python workers for a minute, beside those of the next stage; without this each
    holds what Arrow's and C's allocators keep of its last task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def row_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of whole rows whose texts in ``column`` have at most ``limit`` bytes; a longer text is a slice alone."""
    _, offsets = byte_column(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def byte_column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and each row's place in them; a null has none."""
    held = texts.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2], np.uint8) if held.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def array_literal(spark: SparkSession, values: np.ndarray, kind: str) -> Column:
    """A literal array of fixed-width numbers in Spark's own layout: none boxed, none parsed."""
    n, dtype = len(values), {"int": "<i4", "bigint": "<i8", "double": "<f8"}[kind]
    raw = np.int64(n).tobytes() + bytes(8 * -(-n // 64)) + np.ascontiguousarray(values, dtype).tobytes()
    raw += bytes(-len(raw) % 8)
    jvm = spark._jvm
    array = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData()
    array.pointTo(raw, jvm.org.apache.spark.unsafe.Platform.BYTE_ARRAY_OFFSET, len(raw))
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(array, jvm.org.apache.spark.sql.types.DataType.fromDDL(f"array<{kind}>"))
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def partitions_for(df: DataFrame, floor: int = 1) -> int:
    """Shuffle width the session asks for; the cluster sizes it to its input."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, count: str, value: str, total: int) -> DataFrame:
    """Left join of ``table``'s ``value`` onto ``rows`` by ``key``, safe for hot keys.

    ``count`` says how many of the ``total`` rows have the key. Keys of over a thousandth of the
    rows, hence fewer than a thousand keys, are broadcast; only the other rows are shuffled.
    """
    hot = table.where(F.col(count) > max(1000, total // 1000)).select(F.col(key), F.col(value).alias("__hot"))
    tried = rows.join(F.broadcast(hot), key, "left")
    cold = table.where(F.col(count) <= max(1000, total // 1000)).select(key, value)
    found = tried.where(F.col("__hot").isNull()).drop("__hot").join(cold, key, "left")
    return found.unionByName(tried.where(F.col("__hot").isNotNull()).withColumnRenamed("__hot", value))
