"""The best rows for each of a bounded set of query vectors, by matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores held at once in a task.
SCORES = 4_000_000


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``column`` that have ``size`` numbers, and those as a matrix."""
    rows = np.flatnonzero(pc.equal(pc.list_value_length(column), size).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    return rows, flat.to_numpy(zero_copy_only=False).reshape(len(rows), size)


class _Best:
    """Up to k rows a query so far: a table ``__q, __score, ...`` and the least score that still counts."""

    def __init__(self, queries: int, k: int, order: list[str]):
        self.k, self.tables, self.n = k, [], 0
        self.floor = np.full(queries, -np.inf)
        self.limit = max(100_000, 4 * queries * k)
        self.by = [("__q", "ascending"), ("__score", "descending"), *((c, "ascending") for c in order)]

    def add(self, table: pa.Table) -> None:
        self.tables.append(table)
        self.n += table.num_rows
        if self.n > self.limit:
            self.compact()

    def compact(self) -> pa.Table | None:
        if not self.tables:
            return None
        every = pa.concat_tables(self.tables)
        every = every.take(pc.sort_indices(every, self.by, null_placement="at_start"))
        q = every["__q"].to_numpy()
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        every = every.filter(pa.array(place < self.k))
        last = np.flatnonzero(place == self.k - 1)
        self.floor[q[last]] = every["__score"].to_numpy()[np.searchsorted(np.flatnonzero(place < self.k), last)]
        self.tables, self.n = [every], every.num_rows
        return every


def top_rows(queries: np.ndarray, ids: pa.Array, id_name: str, k: int, order: list[str], digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow step that keeps each query's k best rows of a task: first column the vector, the others go along.

    Equal scores go by the columns ``order``. Rows whose vector is null, of another length or with
    a null in it have no score and are left out.
    """
    length = np.sqrt((queries * queries).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, schema = _Best(len(queries), k, order), None
        step = max(1, SCORES // len(queries))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                payload = pa.Table.from_batches([batch]).drop_columns([batch.schema.names[0]])
                schema = payload.schema
                rows, v = _vectors(batch.column(0), queries.shape[1])
                payload = payload.take(pa.array(rows))
                placed = pc.sort_indices(payload, [(c, "ascending") for c in order], null_placement="at_start").to_numpy()
                v = v[placed]
                scores = np.round(v @ queries.T / (np.sqrt((v * v).sum(axis=1))[:, None] * length + 1e-9), digits)
                taken, found, values = [], [], []
                for q in range(len(queries)):
                    s = scores[:, q]
                    good = np.flatnonzero(s >= best.floor[q])
                    if len(good) > k:
                        cut = np.partition(s[good], len(good) - k)[len(good) - k]
                        above = good[s[good] > cut]
                        good = np.concatenate([above, good[s[good] == cut][: k - len(above)]])
                    taken.append(placed[good])
                    found.append(np.full(len(good), q))
                    values.append(s[good])
                if sum(map(len, taken)):
                    table = payload.take(pa.array(np.concatenate(taken)))
                    best.add(table.append_column("__q", pa.array(np.concatenate(found), pa.int64())).append_column("__score", pa.array(np.concatenate(values))))
        kept = best.compact()
        if kept is not None:
            named = ids.take(kept["__q"].combine_chunks())
            out = pa.table([named, *(kept[c] for c in schema.names), kept["__score"]], names=[id_name, *schema.names, "score"])
            yield from out.to_batches(max_chunksize=10_000)

    return run
