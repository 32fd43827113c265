"""Near duplicates by a MinHash LSH forest, confirmed on full shingle sets.

Equal sets are one class. Each class has a MinHash signature; every tree of the forest sorts the
classes by its own order of the signature's positions, and neighbours with a common prefix are
candidates. A region (run of equal prefixes) that is crowded is read one position deeper, and so
on, until it is small; ordinary regions stay shallow and so keep their recall. In each region a row
is paired with one leader alone, whose signature is near; exact Jaccard on whole sets confirms, and
contraction gives the components. Where near pairs without a leader remain between components, the
region's rows are tested together on whole sets. Rows of crowded regions form crowds, in which every
pair of rows that are not yet in one component is tested on whole sets, a pair of blocks of rows at
a time. So rows and tests grow with the members of a group, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import hot_lookup, partitions_for, persist_table, released
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import MinHasher, jaccard_counts, mixed_bits, shingle_set

#: Signature length, trees, label length, least depth and the size above which a region goes deeper.
POSITIONS, TREES, DEPTH, LEAST_DEPTH, REGION = 256, 32, 10, 4, 96
#: How many deviations an estimate may lie below the threshold.
DEVIATIONS = 5
#: Rows and shingles a block of a crowd has about, and distinct shingles counted at a time.
BLOCK, BLOCK_SHINGLES, STRIP = 1000, 1_000_000, 4096
#: Slots, a power of two, of the table that orders the shingles of crowds (a byte each).
SLOTS = 1 << 22

_SIG = "doc_id long, text_key long, n_shingles long, set_key binary, sig binary"


def _orders() -> np.ndarray:
    """Positions each tree sorts by: consecutive shuffles, so every position serves evenly."""
    rng = np.random.default_rng(23)
    flat = np.concatenate([rng.permutation(POSITIONS) for _ in range(-(-TREES * DEPTH // POSITIONS) + TREES)])
    return np.stack([rng.permutation(flat[i * POSITIONS : (i + 1) * POSITIONS])[:DEPTH] for i in range(TREES)])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = MinHasher(POSITIONS)
    for batch in batches:
        counts, keys, sigs = [], [], []
        for text in batch.column(2):
            s = shingle_set(text.as_py())
            counts.append(len(s))
            keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            sigs.append(hasher.signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "set_key", "sig"],
        )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal-length values as big-endian 16-bit rows."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, width)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = _orders()
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column(1), POSITIONS)
        for tree, order in enumerate(orders):
            label = np.ascontiguousarray(sig[:, order]).tobytes()
            labels = [label[i : i + 2 * DEPTH] for i in range(0, len(label), 2 * DEPTH)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, tree, np.int32)), pa.array(labels, pa.binary()), batch.column(0)],
                names=["tree", "label", "node"],
            )


def regions_of(tree: np.ndarray, labels: np.ndarray, limit: int = REGION) -> Iterator[tuple[int, int, int]]:
    """``(first, end, depth)`` of the candidate regions of rows sorted by tree and label.

    A run of labels equal to LEAST_DEPTH positions is a region; while it has more than ``limit``
    rows it is cut into its runs one position deeper. Runs still crowded at full depth become
    windows of ``limit`` rows that overlap by half, so each row meets its sorted neighbours.
    """
    n = len(tree)
    if n < 2:
        return
    same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)
    same[tree[1:] != tree[:-1]] = 0
    todo = [(0, n, LEAST_DEPTH)]
    while todo:
        a, b, depth = todo.pop()
        cut = np.flatnonzero(same[a : b - 1] < depth) + a + 1
        edges = np.concatenate([[a], cut, [b]])
        wide = np.flatnonzero(np.diff(edges) > 1)
        for i in wide:
            x, y = int(edges[i]), int(edges[i + 1])
            if y - x <= limit:
                yield x, y, depth
            elif depth < labels.shape[1]:
                todo.append((x, y, depth + 1))
            else:
                for at in range(x, y - limit // 2, limit // 2):
                    yield at, min(y, at + limit), depth


def crowds_of(tree: np.ndarray, labels: np.ndarray, limit: int = REGION) -> Iterator[tuple[int, int, bool]]:
    """``(first, end, at_edge)`` of the runs of LEAST_DEPTH equal positions that are crowded or may go on elsewhere.

    The first and the last run of the sorted rows may have been cut, so they are given whatever their size.
    """
    n = len(tree)
    if not n:
        return
    same = (labels[1:, :LEAST_DEPTH] == labels[:-1, :LEAST_DEPTH]).all(axis=1) & (tree[1:] == tree[:-1])
    edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]])
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at_edge = x == 0 or y == n
        if at_edge or y - x > limit:
            yield x, y, at_edge


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of candidate regions (hub null), and rows of crowds, each with a row (hub) of its crowd.

    A row of a crowd has a region only where it stands for a run that may go on in other tasks. The
    regions of crowds are deep: the crowd's tests follow.
    """

    def emit_crowds(tree: np.ndarray, labels: np.ndarray, ids: np.ndarray, raw: list[bytes]):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keys, reps = [], []
        for x, y, at_edge in crowds_of(tree, labels):
            hub = find(int(ids[x]))
            for i in ids[x + 1 : y].tolist():
                root[find(i)] = hub
            if at_edge:
                keys.append(xxhash.xxh128_digest(b"crowd" + int(tree[x]).to_bytes(2, "big") + raw[x][: 2 * LEAST_DEPTH]))
                reps.append(int(ids[x]))
        nodes = list(root)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None] * len(nodes) + keys, pa.binary()),
                pa.array(nodes + reps, pa.int64()),
                pa.array([find(i) for i in nodes] + reps, pa.int64()),
                pa.array([True] * (len(nodes) + len(keys))),
            ],
            names=["region", "node", "hub", "deep"],
        )

    def emit(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        tree = table.column(0).to_numpy()
        raw = table.column(1).to_pylist()
        labels = np.frombuffer(b"".join(raw), ">u2").reshape(-1, DEPTH)
        ids = table.column(2).to_numpy()
        keys, members, deep = [], [], []
        for a, b, depth in regions_of(tree, labels):
            key = xxhash.xxh128_digest(int(tree[a]).to_bytes(2, "big") + int(ids[a]).to_bytes(8, "big", signed=True) + raw[a][: 2 * depth])
            keys += [key] * (b - a)
            deep += [depth > LEAST_DEPTH] * (b - a)
            members.append(ids[a:b])
        if keys:
            found = np.concatenate(members)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(found), pa.nulls(len(found), pa.int64()), pa.array(deep)], names=["region", "node", "hub", "deep"]
            )
        yield emit_crowds(tree, labels, ids, raw)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > 2_000_000:  # bounded memory; a region cut here is a crowd
            yield from emit(held)
            held, rows = [], 0
    if rows:
        yield from emit(held)


def least_estimate(per_cent: int) -> float:
    """Share of equal positions from which a pair is tested exactly."""
    share = per_cent / 100
    return share - DEVIATIONS * (share * (1 - share) / POSITIONS) ** 0.5


def leaders(sig: np.ndarray, least: float, sure: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs (row, leader) of signatures, and rows with a near one that is not their leader or led by them.

    A row's leader is the first row before it that agrees in ``sure`` of the positions, else the one
    before it that agrees most, if in ``least``.
    """
    pairs, open_ = [], set()
    for i in range(1, len(sig)):
        alike = (sig[:i] == sig[i]).mean(axis=1)
        near = np.flatnonzero(alike >= least)
        if len(near):
            certain = np.flatnonzero(alike >= sure)
            leader = int(certain[0] if len(certain) else alike.argmax())
            pairs.append((i, leader))
            if len(near) > 1:
                open_.update(near[near != leader].tolist())
                open_.add(i)
    return pairs, sorted(open_)


def _meet(least: float, sure: float):
    """Rows sorted by region: pairs ``a, b`` of a row and its leader, and rows ``a`` left open in a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        opened: list[tuple[int, bytes]] = []

        def meet(region: bytes, deep: bool, ids: np.ndarray, sig: np.ndarray) -> None:
            order = np.argsort(ids, kind="stable")
            ids, sig = ids[order], sig[order]
            found, left = leaders(sig, least, sure)
            pairs.update((int(ids[i]), int(ids[j])) for i, j in found)
            if not deep:
                opened.extend((int(ids[i]), region) for i in left)

        def out():
            cols = [[a for a, _ in pairs] + [a for a, _ in opened], [b for _, b in pairs] + [None] * len(opened), [None] * len(pairs) + [r for _, r in opened]]
            pairs.clear(), opened.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["a", "b", "region"])

        key, deep, ids, sigs = None, False, [], []
        for batch in batches:
            regions, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            node, sig = batch.column(1).to_numpy(), _matrix(batch.column(3), POSITIONS) if batch.num_rows else None
            starts = [i for i in range(len(regions)) if i == 0 or regions[i] != regions[i - 1]]
            for x, y in zip(starts, [*starts[1:], len(regions)]):
                if regions[x] != key:
                    if ids:
                        meet(key, deep, np.concatenate(ids), np.concatenate(sigs))
                    key, deep, ids, sigs = regions[x], marks[x], [], []
                ids.append(node[x:y])
                sigs.append(sig[x:y])
            if len(pairs) + len(opened) > 20_000:
                yield out()
        if ids:
            meet(key, deep, np.concatenate(ids), np.concatenate(sigs))
        yield out()

    return run


def _confirm(per_cent: int):
    """Rows sorted by a, its own text first, then its candidates' texts; exact test on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            left, right = [], []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a == b:
                    at, own = a, shingle_set(text)
                elif a == at:
                    both, union = jaccard_counts(own, shingle_set(text))
                    if 100 * both >= per_cent * union:
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts as shingle sets."""
    for batch in batches:
        sets = [shingle_set(t).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "members"])


def linked(sets: list[np.ndarray], split: int, per_cent: int) -> np.ndarray:
    """Which rows before ``split`` and from it on are alike, as a matrix; all with all if ``split`` is 0."""
    sizes = np.array([len(x) for x in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    width = int(col.max()) + 1
    if split:
        seen = (np.bincount(col[rows < split], minlength=width) > 0) & (np.bincount(col[rows >= split], minlength=width) > 0)
    else:
        seen = np.bincount(col, minlength=width) > 1
    kept = seen[col]
    rows, col = rows[kept], (np.cumsum(seen) - 1)[col[kept]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    both = np.zeros((len(sizes[left]), len(sizes[right])))
    for at in range(0, int(seen.sum()), STRIP):
        x, y = np.searchsorted(col, [at, at + STRIP])
        strip = np.zeros((len(sets), min(STRIP, int(seen.sum()) - at)), np.float32)
        strip[rows[x:y], col[x:y] - at] = 1
        both += strip[left] @ strip[right].T
    union = sizes[left][:, None] + sizes[right] - both
    return 100 * both >= per_cent * union


def _forest(near: np.ndarray, split: int, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links between components that span what ``near`` connects, at most one a row."""
    if split:
        whole = np.zeros((len(comp), len(comp)), bool)
        whole[:split, split:], whole[split:, :split] = near, near.T
        near = whole
    left = np.ones(len(comp), bool)
    out = []
    for first in range(len(comp)):
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            todo += new.tolist()
            out += [(int(comp[i]), int(comp[j])) for j in new if comp[i] != comp[j]]
    return list(dict.fromkeys(out))


def _test_blocks(per_cent: int):
    """Rows sorted by pair and side: components linked between the two blocks (or inside one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def test(rows: list[tuple]):
            sides = [r[1] for r in rows]
            split = sides.index(1) if 1 in sides and sides[0] == 0 else 0
            if len(rows) > 1 and (split or sides[0] == 2):
                near = linked([np.frombuffer(r[3], np.uint64) for r in rows], split, per_cent)
                return _forest(near, split, np.array([r[2] for r in rows]))
            return []

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        key, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != key:
                    if rows:
                        yield out(test(rows))
                    key, rows = row[0], []
                rows.append(row)
        if rows:
            yield out(test(rows))

    return run


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the named nodes, one row each: a text of the class, found by its id and the text's hash."""
    wanted = nodes.join(classes.select("node", F.col("rep").alias("doc_id"), "text_key"), "node")
    return docs.join(wanted.hint("merge"), ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"])


def _open_links(docs: DataFrame, classes: DataFrame, opened: DataFrame, found: DataFrame, per_cent: int, width: int) -> DataFrame:
    """``a, b``: components of ``found`` that exact tests link within regions with open rows of several components."""
    rows = opened.join(found, "node", "left").select("region", "node", F.coalesce("first", "node").alias("comp"))
    rows = persist_table(rows, "opened")
    mixed = rows.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("region")
    rows = persist_table(rows.join(mixed, "region"), "mixed")
    texts = _texts(docs, classes, rows.select("node").distinct())
    sets = rows.join(texts, "node").select("region", F.lit(2).alias("side"), "comp", "text")
    sets = sets.repartition(width, "region").sortWithinPartitions("region")
    return sets.mapInArrow(released(_sets), "region binary, side int, comp long, members binary").mapInArrow(released(_test_blocks(per_cent)), "a long, b long")


def _keys(sets: list[np.ndarray], clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of some sets, and one after another their shingles' keys within each set's cluster."""
    sizes = np.array([len(x) for x in sets], np.int64)
    salt = mixed_bits(clusters.astype(np.uint64) + np.uint64(1))
    return sizes, mixed_bits(np.concatenate(sets) ^ np.repeat(salt, sizes)).view(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``comp, key`` for each shingle of each set."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
        ends = np.cumsum([len(x) for x in sets]) // BLOCK_SHINGLES
        for part in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(ends)) + 1) if sets else []:
            sizes, keys = _keys([sets[i] for i in part], batch.column(1).to_numpy()[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(2).to_numpy()[part], sizes)), pa.array(keys)], names=["comp", "key"])


def _first_places(ranks, per_cent: int):
    """``a, b``: each row with the shingles in its first places that several components have, as numbers below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for batch in batches:
            nodes, shingles = [], []
            for node, cluster, members in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                _, keys = _keys([np.frombuffer(members, np.uint64)], np.array([cluster]))
                rank = table[keys & (SLOTS - 1)]
                common = keys[rank > 0]
                places = 1 - (per_cent * len(keys) + 99) // 100 + len(common)  # first places less those of one component's own
                if places > 0:
                    first = common[np.lexsort((common, rank[rank > 0]))[:places]]
                    nodes.append(np.full(len(first), node, np.int64))
                    shingles.append(-1 - (first.view(np.uint64) >> np.uint64(1)).astype(np.int64))
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, shingles))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _prefix_clusters(sets: DataFrame, per_cent: int) -> DataFrame:
    """``node, cluster``: rows of ``sets(node, cluster, comp, members)`` of different components that may be alike,
    in clusters outside which none is.

    Shingles are put in one order: those of one component alone first, then by the power of two of
    their count in the cluster. Two sets alike in ``per_cent`` share a shingle among the first
    size - least common size + 1 of either, so rows are only connected over such shingles. Shingles of
    one component alone connect nothing new, but take up the first places; rows whose first places
    they fill are left out. The order is a table of SLOTS small numbers, whatever the input: shingles
    that meet in a slot share its number, which any order allows, so a full table costs tests and
    loses nothing. Counting exchanges one narrow row a shingle, summed before.
    """
    tokens = sets.select("node", "cluster", "comp", "members").mapInArrow(released(_tokens), "comp long, key long")
    several = tokens.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    slot = F.col("key").bitwiseAND(SLOTS - 1).alias("slot")
    ranked = persist_table(several.groupBy(slot).agg(F.max(F.ceil(F.log2("n"))).cast("byte").alias("rank")), "crowd-shingles")
    held = ranked.toArrow()  # at most SLOTS rows
    table = np.zeros(SLOTS, np.uint8)
    table[held["slot"].to_numpy()] = held["rank"].to_numpy()
    ranks = sets.sparkSession.sparkContext.broadcast(table)
    edges = sets.select("node", "cluster", "comp", "members").mapInArrow(released(_first_places(ranks, per_cent)), "a long, b long")
    graph = connected_components(edges)  # shingles are nodes below zero
    return graph.where("node >= 0").select("node", F.col("component").alias("cluster"))


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows`` of clusters with more than one component; a cluster may hold very many of them."""
    stats = persist_table(rows.groupBy("cluster").agg(F.count("*").alias("n"), (F.min("comp") != F.max("comp")).alias("several")), "crowd-clusters")
    total = stats.agg(F.sum("n")).first()[0] or 0
    return hot_lookup(rows, stats, "cluster", "n", "several", total).where("several").drop("several")


def _crowd_links(docs: DataFrame, classes: DataFrame, crowds: DataFrame, found: DataFrame, per_cent: int, width: int) -> DataFrame:
    """``a, b``: components of ``found`` that exact tests link within crowds.

    Rows connected over crowded regions are one cluster; those that share a crowded region with a
    row are all in its cluster. An exact prefix filter cuts it into the clusters of rows that may be
    alike at all, so rows that share a passage alone are not tested. A cluster's rows are dealt by
    hash into blocks: components larger than a block get blocks of their own, the others share
    blocks. Every pair of blocks is one test, but for blocks of the same one component, so a group
    found whole costs nothing more.
    """
    cut = crowds.where("region is not null")
    joined = cut.select("node", F.min("node").over(Window.partitionBy("region")).alias("hub"))
    clusters = connected_components(crowds.where("region is null").select("node", "hub").unionByName(joined).toDF("a", "b"))
    rows = clusters.join(found, "node", "left").select("node", F.col("component").alias("cluster"), F.coalesce("first", "node").alias("comp"))
    rows = persist_table(_mixed(persist_table(rows, "crowd-rows")), "crowds")
    texts = rows.join(_texts(docs, classes, rows.select("node")), "node").select("node", "cluster", "comp", "text")
    sets = persist_table(texts.mapInArrow(released(_sets), "node long, cluster long, comp long, members binary"), "crowd-sets")
    near = rows.select("node", "comp").join(_prefix_clusters(sets, per_cent), "node")
    near = persist_table(_mixed(persist_table(near.select("node", "cluster", "comp"), "crowd-near")), "crowd-mixed")
    sets = persist_table(sets.select("node", "members").join(near, "node").select("node", "cluster", "comp", "members"), "crowd-tested")
    parts = sets.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum(F.length("members") / 8).alias("m"))
    size = lambda n, m: F.ceil(F.greatest(n / BLOCK, m / BLOCK_SHINGLES))
    parts = parts.withColumn("own", size(F.col("n"), F.col("m")))
    shared = parts.where("own = 1").groupBy("cluster").agg(size(F.sum("n"), F.sum("m")).alias("shared"))
    parts = persist_table(parts.join(shared, "cluster", "left"), "crowd-parts")
    # a block is (pure component or null, number)
    pure = F.when(F.col("own") > 1, F.col("comp"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = parts.where("own > 1").select("cluster", pure.alias("pure"), numbers(F.col("own")).alias("no"))
    blocks = blocks.unionByName(
        parts.where("own = 1").select("cluster", "shared").distinct().select("cluster", F.lit(None).cast("long").alias("pure"), numbers(F.col("shared")).alias("no"))
    )
    blocks = blocks.withColumn("block", F.xxhash64("cluster", F.coalesce("pure", F.lit(-1)), F.col("pure").isNull(), "no"))
    blocks = persist_table(blocks.select("cluster", "pure", "block"), "crowd-blocks")
    other = blocks.select("cluster", F.col("pure").alias("pure2"), F.col("block").alias("block2"))
    apart = F.col("pure").isNull() | F.col("pure2").isNull() | (F.col("pure") != F.col("pure2"))
    pairs = blocks.join(other, "cluster").where(apart & (F.col("block") <= F.col("block2")))
    pairs = pairs.withColumn("pair", F.xxhash64("block", "block2"))
    alone = F.col("block") == F.col("block2")
    sides = pairs.select("block", "pair", F.when(alone, 2).otherwise(0).alias("side"))
    sides = persist_table(sides.unionByName(pairs.where(~alone).select(F.col("block2").alias("block"), "pair", F.lit(1).alias("side"))), "crowd-pairs")
    whole = F.struct("cluster", "comp")
    sized = hot_lookup(sets.withColumn("part", whole), parts.select(whole.alias("part"), "n", F.struct("own", "shared").alias("sizes")), "part", "n", "sizes", int(parts.agg(F.sum("n")).first()[0] or 0))
    placed = sized.select("node", "cluster", "comp", "members", "sizes.own", "sizes.shared").select(
        F.xxhash64(
            "cluster", F.coalesce(pure, F.lit(-1)), pure.isNull(), F.when(F.col("own") > 1, F.pmod(F.xxhash64("node"), "own")).otherwise(F.pmod(F.xxhash64("comp"), "shared"))
        ).alias("block"),
        "comp",
        "members",
    )
    tests = placed.join(sides, "block").select("pair", "side", "comp", "members")
    return tests.repartition(width, "pair").sortWithinPartitions("pair", "side").mapInArrow(released(_test_blocks(per_cent)), "a long, b long")


def near_duplicates(df: DataFrame, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id, kept``.

    Two texts are linked when 100 * |A and B| >= per_cent * |A or B| for their sets of distinct
    five-word shingles; component_id is the smallest id reachable over links. Texts without words
    (null, empty, white space) have n_shingles 0 and stand alone; equal texts and repeated rows
    fall into one class without being paired. The nodes of links are classes of equal sets, so rows
    that share an id but not their text are linked each for itself. A null id takes no part in links
    and is kept with a null component. Other columns of ``df`` are ignored. Work grows with rows,
    trees and leaders; open pairs and crowds are tested region by region and block by block, not
    listed. Hot classes are looked up by broadcast of at most a thousand rows.
    """
    signed, placed = _components(df, per_cent, id_col, text_col)
    least = placed.groupBy("first").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "first").select("set_key", "n", "component_id")
    return _look_up(signed.select("doc_id", "n_shingles", "set_key"), persist_table(placed, "placed"))


def _components(df: DataFrame, per_cent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, n_shingles, set_key, ...`` of every row, and for each class of equal sets ``set_key, rep, text_key, n, first``.

    ``first`` names the class's component, ``rep`` and ``text_key`` its least row.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text")
    signed = persist_table(docs.mapInArrow(released(_sign), _SIG), "signatures")
    first = F.min(F.struct("doc_id", "text_key"))
    classes = persist_table(
        signed.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(first.alias("first"), F.count("*").alias("n"), F.any_value("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "set_key", "n", "sig"),
        "classes",
    )
    docs, width, share = docs.where("doc_id is not null"), partitions_for(df), per_cent / 100
    planted = classes.select("node", "sig").mapInArrow(released(_plant), "tree int, label binary, node long")
    members = persist_table(
        planted.repartitionByRange(width, "tree", "label", "node")
        .sortWithinPartitions("tree", "label", "node")
        .mapInArrow(released(_regions), "region binary, node long, hub long, deep boolean"),
        "regions",
    )
    met = persist_table(
        members.where("hub is null").join(classes.select("node", "sig"), "node")
        .select("region", "node", "deep", "sig")
        .repartition(width, "region")
        .sortWithinPartitions("region")
        .mapInArrow(released(_meet(least_estimate(per_cent), share + (share * (1 - share) / POSITIONS) ** 0.5)), "a long, b long, region binary"),
        "met",
    )
    pairs = persist_table(met.where("b is not null").select("a", "b").distinct(), "pairs")
    stream = pairs.unionByName(pairs.select("a", F.col("a").alias("b")).distinct())
    texts = _texts(docs, classes, stream.select(F.col("b").alias("node")).distinct())
    links = (
        stream.join(texts.withColumnRenamed("node", "b"), "b")
        .select("a", "b", "text")
        .repartition(width, "a")
        .sortWithinPartitions("a", F.col("a") != F.col("b"))
        .mapInArrow(released(_confirm(per_cent)), "a long, b long")
    )
    found = persist_table(connected_components(links).withColumnRenamed("component", "first"), "first")
    for name, more in (
        ("second", lambda: _open_links(docs, classes, met.where("b is null").select("region", F.col("a").alias("node")), found, per_cent, width)),
        ("third", lambda: _crowd_links(docs, classes, members.where("hub is not null"), found, per_cent, width)),
    ):
        merged = persist_table(connected_components(more()), f"{name}-merged")
        if not merged.isEmpty():  # names of components may be nodes that found does not list yet
            named = found.unionByName(merged.join(found, "node", "left_anti").select("node", F.col("node").alias("first")))
            step = named.join(merged.withColumnsRenamed({"node": "first", "component": "last"}), "first", "left")
            found = persist_table(step.select("node", F.coalesce("last", "first").alias("first")), name)
    whole = classes.join(found, "node", "left")
    return signed, persist_table(whole.select("set_key", "rep", "text_key", "n", F.coalesce("first", "node").alias("first")), "components")


def _look_up(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Give each row its class's component; classes of over a thousandth of all rows are broadcast."""
    total = placed.agg(F.sum("n")).first()[0] or 0
    hot = placed.where(F.col("n") > max(1000, total // 1000)).select("set_key", F.col("component_id").alias("hot_id"))
    tried = rows.join(F.broadcast(hot), "set_key", "left").withColumn(
        "seek", F.when(F.col("hot_id").isNull() & F.col("doc_id").isNotNull(), F.col("set_key"))
    )
    sought = tried.where("seek is not null").join(
        placed.select(F.col("set_key").alias("seek"), "component_id"), "seek", "left"
    )
    plain = tried.where("seek is null").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("hot_id")))
    cols = ["doc_id", "n_shingles", "component_id"]
    out = sought.select(*cols).unionByName(plain.select(*cols))
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def representatives(df: DataFrame, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of ``df`` for each group of near duplicates, of the smallest id (then text hash); all columns kept.

    A document is an id with a text: an id that stands at two texts is two documents, judged each by
    itself, and repeated rows that agree in both are one, all of whose rows stay. Documents without
    words and rows with a null id stay.
    """
    signed, placed = _components(df, per_cent, id_col, text_col)
    chosen = placed.groupBy("first").agg(F.min(F.struct("rep", "text_key")).alias("row")).select("row.*")
    wordless = signed.where("doc_id is not null and set_key is null").select("doc_id", "text_key").distinct()
    verdict = chosen.unionByName(wordless.withColumnRenamed("doc_id", "rep")).toDF("__id", "__key")
    own = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__key"))
    named = df.where(F.col(id_col).cast("long").isNotNull())
    return named.join(verdict, own, "left_semi").unionByName(df.where(F.col(id_col).cast("long").isNull()))
