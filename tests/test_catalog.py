"""Every query of the catalog against its SQL twin on the smallest tables, and the entry points."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from lodestone.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return str(v) if isinstance(v, str | bool | np.bool_) else repr(round(float(v), 6))

    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@needs_data
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@needs_data
def test_entry(spark):
    assert entry_points.entry(spark).columns == ["doc_id", "line_no", "function", "content"]
    assert set(catalog.queries()) <= set(entry_points.queries())


@needs_data
def test_only_the_index_scan_pairs_everything(spark):
    """Query vectors against the index is the one stated pairing; nothing else may be a product."""
    for name, query in catalog.queries().items():
        plan = query(spark, DATA)._jdf.queryExecution().toString()
        if name not in ("cosine_topk", "cosine_floor", "recall_union_source"):
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@needs_data
def test_verdict_merge_of_tied_lines(spark, tmp_path):
    """Of an order's lines with one number the first in the table counts, in whatever order its parts are read."""
    os.symlink(f"{DATA}/orders.parquet", tmp_path / "orders.parquet")
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{DATA}/orders.parquet'")
    c.sql(f"create table lineitem as select l.* exclude (i) replace (1::INT as l_linenumber, ['R', 'A', 'N'][i % 3 + 1] as l_returnflag, (i % 9) / 100.0 as l_tax) from (select *, row_number() over () - 1 as i from '{DATA}/lineitem.parquet') l order by i")
    (tmp_path / "lineitem.parquet").mkdir()  # Spark reads the larger file first
    for name, part in ("a", "rowid < 1000"), ("b", "rowid >= 1000"):
        c.sql(f"copy (select * from lineitem where {part} order by rowid) to '{tmp_path}/lineitem.parquet/{name}.parquet' (format parquet)")
    c.sql(f"set threads = 1; create or replace table lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.queries()["verdict_merge"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.sql(catalog.oracle_sql()["verdict_merge"]).df())
