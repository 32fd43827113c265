"""Connected components by hooking: each node to its neighbour of least priority, then contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import persist_table


def _edges(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node named by ``edges(a, b)``; component is its smallest node.

    Loops, repeated and reversed edges are harmless. Nodes without another node are absent. In each
    round every node takes as parent the least of itself and its neighbours in a fixed random order,
    and the edges are drawn between parents; local minima survive, so a path or a dense group shrinks
    by a factor, not by one. Rounds are written to the shared folder and only counted on the driver.
    A hot node's neighbours are pre-aggregated, and joins on it can be split.
    """
    rank = lambda x: F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("x"))
    e = persist_table(edges.where("a <> b").select(*_edges(F.col("a"), F.col("b"))).distinct(), "cc")
    parents: list[DataFrame] = []
    while not e.isEmpty():
        if len(parents) >= max_rounds:
            raise RuntimeError("components did not settle")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        up = persist_table(best.select(F.col("u").alias("node"), F.least(rank("u"), "m")["x"].alias("parent")), "cc-parents")
        parents.append(up)
        one = e.join(up.withColumnsRenamed({"node": "u", "parent": "pu"}), "u").select("pu", "v")
        two = one.join(up.withColumnsRenamed({"node": "v", "parent": "pv"}), "v").where("pu <> pv")
        e = persist_table(two.select(*_edges(F.col("pu"), F.col("pv"))).distinct(), "cc")
    if not parents:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = parents[-1].withColumnRenamed("parent", "root")
    for up in reversed(parents[:-1]):
        above = roots.select(F.col("node").alias("parent"), F.col("root").alias("__root"))
        roots = up.join(above, "parent", "left").select("node", F.coalesce("__root", "parent").alias("root"))
    roots = persist_table(roots, "cc-roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
