import subprocess
import sys
from pathlib import Path

import __spark_entry__
from lodestone.llm import entries

UNSET = """
from pyspark.sql import SparkSession
from lodestone.llm.common import persist_table, scratch_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert persist_table(spark.range(3), "t").count() == 3 and scratch_dir(spark) == scratch_dir(spark)
"""


def test_names():
    names = set(entries.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert names <= set(__spark_entry__.queries()) and set(entries.oracle_sql()) <= names


def test_scratch_folder_without_a_setting():
    top = Path(__file__).resolve().parents[2]
    subprocess.run([sys.executable, "-c", UNSET], cwd=top, check=True, timeout=120)
