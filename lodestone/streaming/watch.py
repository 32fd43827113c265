"""Keep the index up to date from a stream of files. An extension: the audit itself is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.merging import first_per_key
from lodestone.plans.audit import build_index
from lodestone.sources.stores import SnapshotStore

FILE = "path string, content string, seen_at timestamp"


def absorb(batch: DataFrame, store: SnapshotStore, language: str, embed: Callable[[Column], Column] | None = None) -> None:
    """Put a batch of file versions over the stored tree (the latest of a path counts; a null content
    deletes) and build the index incrementally."""
    latest = first_per_key(batch, ["path"], [F.desc("seen_at"), F.desc("content")])
    if store.exists("files"):
        kept = store.read("files").join(latest.select("path"), "path", "left_anti")
        rows = kept.unionByName(latest.where("content is not null").select("path", "content", F.md5("content").alias("md5")))
    else:
        rows = latest.where("content is not null").select("path", "content", F.md5("content").alias("md5"))
    build_index(store.write("files", rows), store, language, embed)


def watch(spark: SparkSession, source: str, store: SnapshotStore, language: str, checkpoint: str, embed: Callable[[Column], Column] | None = None, once: bool = True):
    """Start a query that absorbs JSON file versions (FILE) as they arrive in ``source``."""
    stream = spark.readStream.schema(FILE).json(source)
    writer = stream.writeStream.foreachBatch(lambda df, _: absorb(df, store, language, embed)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
