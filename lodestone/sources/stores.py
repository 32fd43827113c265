"""Plans, packages, votes and the vector index as stored tables; snapshots swap atomically."""

from __future__ import annotations

import json
import os
import threading
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import constants as K

CANDIDATE = (
    "id string, task_id string, ord long, function string, file string, line int, cwe_id string, matched_cwes array<string>, code string, context string, "
    "entrypoint string, verdict string, explanation string, recall_source string, votes array<struct<lens:string,is_real:boolean,reason:string>>"
)
TASK = "id string, cwe_id string, cwe_name string, description string, query_intents array<string>, vulnerability_prompt string, status string, all_cwes array<string>"
VOTE = "candidate_id string, lens string, is_real boolean, confidence string, reason string, has_path boolean, attack_path string, has_missing boolean, missing string"
PACKAGE = "id string, file string, function string, cwe_id string, matched_cwes array<string>, weaknesses array<string>, prompt string, code string, context string"

CATALOG = (
    "id string, name string, description string, extended_description string, consequences array<struct<scopes:array<string>,impacts:array<string>,note:string>>, languages array<string>, "
    "demonstrative_examples array<struct<language:string,intro:string,code:string>>, observed_examples array<struct<cve:string,description:string>>, "
    "potential_mitigations array<struct<phase:string,description:string>>"
)


def load_rules(path: str | None = None) -> dict:
    """Technology rules of a JSON file (keys with a leading underscore dropped), else the built-in ones."""
    if not path:
        return dict(K.PRESCAN_RULES)
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        return {k: (v["patterns"], [str(c) for c in v["cwes"]]) for k, v in given.items() if not k.startswith("_")}
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
        warnings.warn(f"technology rules {path} can't be read ({e}); the built-in ones stay", stacklevel=2)
        return dict(K.PRESCAN_RULES)


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class SnapshotStore:
    """Tables under one folder, each a series of committed versions 1, 2, ...

    A version is an entry of the table's log that names the folder with its rows. The entry appears
    whole or not at all, and only one writer can create it, so a reader sees a whole version or the
    one before at any time, and of two writers that began from one version the later gets Conflict.
    ``update`` then begins anew from the other's version, so that no change is lost.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _log(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/_log/{version:010d}"

    def _commit(self, name: str, version: int, folder: str) -> None:
        """Create the log entry unless there is one: by a link or a rename that does not replace."""
        jvm = self.spark._jvm
        fs, target = self._fs(self._log(name, version))
        draft = f"{self.root}/{name}/_drafts/{uuid.uuid4().hex}"
        _, source = self._fs(draft)
        stream = fs.create(source, False)
        stream.write(bytearray(folder.encode()))
        stream.close()
        fs.mkdirs(target.getParent())
        try:
            if fs.getScheme() == "file":  # a link is refused where the name exists
                os.link(source.toUri().getPath(), target.toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, none)
        except Exception as e:
            if fs.exists(target):
                raise Conflict(f"{name} has a version {version}") from e
            raise
        finally:
            if fs.exists(source):
                fs.delete(source, False)

    def version(self, name: str) -> int:
        """The latest committed version; 0 without one."""
        fs, path = self._fs(f"{self.root}/{name}/_log")
        if not fs.exists(path):
            return 0
        found = [x.getPath().getName() for x in fs.listStatus(path)]
        return max((int(x) for x in found if x.isdigit()), default=0)

    def exists(self, name: str) -> bool:
        return self.version(name) > 0

    def _folder(self, name: str, version: int) -> str:
        fs, path = self._fs(self._log(name, version))
        stream = fs.open(path)
        folder = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return f"{self.root}/{name}/{folder}"

    def read(self, name: str, version: int | None = None) -> DataFrame:
        n = self.version(name) if version is None else version
        if not n:
            raise FileNotFoundError(f"{self.root}/{name}")
        folder = self._folder(name, n)
        rows = self.spark.read.parquet(folder)
        return BucketedTable.rows(rows) if BUCKET in rows.columns else rows

    def write(self, name: str, df: DataFrame, after: int | None = None) -> DataFrame:
        """Commit ``df`` as the next version, or as the one after ``after``, else Conflict."""
        folder = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        while True:
            base = self.version(name) if after is None else after
            try:
                self._commit(name, base + 1, folder)
                return self.read(name, base + 1)
            except Conflict:
                if after is not None:
                    raise

    def update(self, name: str, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> DataFrame:
        """Commit ``change`` of the latest version; if another writer was first, of that one's."""
        for _ in range(tries):
            base = self.version(name)
            try:
                return self.write(name, change(self.read(name, base or None)), base)
            except Conflict:
                continue
        raise Conflict(f"{name} was changed by others {tries} times")

    def size(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def bucketed(self, name: str, key: str, buckets: int = 64) -> BucketedTable:
        return BucketedTable(self, name, key, buckets)


#: Column of a bucketed table's folders, and parts that a bucket's rows are written by.
BUCKET, PARTS = "__bucket", 4


class BucketedTable:
    """A table of a store in buckets of a key's hash, of which a change rewrites only those it touches.

    The buckets are the folders of one Parquet table, and Spark's dynamic partition overwrite puts
    the touched ones in their place; files of other buckets stay as they are. Each written bucket
    holds a row without a key, so that a bucket whose last row went is emptied too. The table has
    one writer at a time; a writer that dies leaves whole buckets, old or new ones.
    """

    def __init__(self, store: SnapshotStore, name: str, key: str, buckets: int = 64):
        self.store, self.name, self.key, self.buckets = store, name, key, buckets

    @staticmethod
    def rows(stored: DataFrame) -> DataFrame:
        return stored.where("__key is not null").drop(BUCKET, "__key")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def replace(self, keys: DataFrame, rows: DataFrame) -> int:
        """Put ``rows`` in place of all rows of ``keys(key)``; returns how many buckets were written.

        Keys without rows are gone afterwards. ``rows`` are of those keys alone.
        """
        spark, version = self.store.spark, self.store.version(self.name)
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # at most one number a bucket
        if not touched and version:
            return 0
        if version:
            folder = self.store._folder(self.name, version)
            stored = spark.read.parquet(folder).where(F.col(BUCKET).isin(touched)).where("__key is not null")
            kept = stored.drop(BUCKET, "__key").join(keys.select(self.key).distinct(), self.key, "left_anti")
            rows = kept.select(*rows.columns).unionByName(rows)
        else:
            folder = f"{self.store.root}/{self.name}/buckets-{uuid.uuid4().hex}"
        out = rows.withColumn("__key", F.col(self.key).cast("string")).withColumn(BUCKET, self._bucket())
        marks = spark.createDataFrame([(b,) for b in touched or [0]], "b int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema[:-1]), F.col("b").alias(BUCKET))
        spread = F.pmod(F.xxhash64(self.key, *[c for c in rows.columns if rows.schema[c].dataType.typeName() in ("string", "integer", "long")]), F.lit(PARTS))
        placed = out.unionByName(marks).repartition(BUCKET, spread)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)
        self.store._commit(self.name, version + 1, folder.rsplit("/", 1)[1])
        return len(touched)


def to_json_lines(df: DataFrame, beside: list[str] | None = None) -> DataFrame:
    """``value``: each row as one JSON object; nulls are written, so that every field is there. Columns ``beside`` stay columns."""
    beside = beside or []
    return df.select(*beside, F.to_json(F.struct(*[c for c in df.columns if c not in beside]), {"ignoreNullFields": "false"}).alias("value"))


def from_json_lines(lines: DataFrame, schema: str, required: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of the objects in the column ``value``, and ``reason, n`` of the lines left out.

    A line that is no object of the schema is left out as broken, one whose field ``required`` is
    null as incomplete. Other columns of ``lines`` stay beside the fields.
    """
    held = [c for c in lines.columns if c != value]
    row = F.from_json(F.col(value), f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    parsed = lines.select(*held, F.explode(F.array(row)).alias("__row"))  # so that a line is parsed once, not for each use
    broken = F.col("__row").isNull() | F.col("__row.__corrupt").isNotNull()
    reason = F.when(broken, "broken").when(F.col(f"__row.{required}").isNull(), "incomplete")
    told = parsed.withColumn("__reason", reason)
    rows = told.where("__reason is null").select(*held, "__row.*").drop("__corrupt")
    lost = told.where("__reason is not null").groupBy(F.col("__reason").alias("reason")).agg(F.count("*").alias("n"))
    return rows, lost


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Candidate packages, one a file ``cand-*.json`` or as write_packages has written them.

    Broken ones and those without a file are left out (lost_packages counts them), backslashes become slashes.
    """
    return _packages(spark, path)[0].withColumn("file", F.replace("file", F.lit("\\"), F.lit("/")))


def lost_packages(spark: SparkSession, path: str) -> DataFrame:
    """``reason, n`` of the packages that read_packages leaves out."""
    return _packages(spark, path)[1]


def _packages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    read = lambda glob, whole: spark.read.option("pathGlobFilter", glob).text(path, wholetext=whole)
    return from_json_lines(read("cand-*.json", True).unionByName(read("part-*.json", False)), PACKAGE, "file")


def write_packages(packages: DataFrame, path: str) -> None:
    """All packages as one JSON-lines dataset; read_packages gives them back."""
    packages.write.mode("overwrite").json(path)


_LANGUAGES_HELD = threading.RLock()


@contextmanager
def languages_of(path: str | None) -> Iterator[None]:
    """Within the block the language tables are those of the file (see load_languages), afterwards those of before.

    Blocks of several threads follow one another, so that no run sees another's tables.
    """
    with _LANGUAGES_HELD:
        tables = (K.LANGUAGES, K.MARKDOWN_TAGS, K.LANGUAGE_ALIASES, K.EXTENSION_LANGUAGE)
        before, signals = [dict(t) for t in tables], list(K.COMMON_SIGNALS)
        try:
            if path:
                load_languages(path)
            yield
        finally:
            for table, old in zip(tables, before):
                table.clear()
                table.update(old)
            K.COMMON_SIGNALS[:] = signals


def load_languages(path: str) -> None:
    """Take the language tables of a JSON file for this process; without a readable one the built-in ones stay.

    Keys: languages (each with markdown_tag, extensions, cwe_aliases, type_kinds, resource_signals),
    aliases, ext_to_lang and _common_resource_signals.
    """
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        parts = ("extensions", "cwe_aliases", "type_kinds", "resource_signals")
        languages = {k: tuple(list(v.get(part, [])) for part in parts) for k, v in given["languages"].items()}
        tags = {k: v.get("markdown_tag", k) for k, v in given["languages"].items()}
    except (OSError, ValueError, KeyError, AttributeError) as e:
        warnings.warn(f"language tables {path} can't be read ({e}); the built-in ones stay", stacklevel=2)
        return
    for table, new in ((K.LANGUAGES, languages), (K.MARKDOWN_TAGS, tags), (K.LANGUAGE_ALIASES, given.get("aliases", {})), (K.EXTENSION_LANGUAGE, given.get("ext_to_lang", {}))):
        table.clear()
        table.update(new)
    K.COMMON_SIGNALS[:] = given.get("_common_resource_signals", [])


def write_catalog_json(catalog: DataFrame, path: str) -> str:
    """Write the catalog; the returned line of JSON tells how many weaknesses it has."""
    catalog.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return json.dumps({"count": read_catalog_json(catalog.sparkSession, path).count(), "output": path})


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """The catalog that write_catalog_json has written; lines that are no weakness are left out."""
    return from_json_lines(spark.read.text(path), CATALOG, "id")[0]


def workspace(root: str, base: str | None = None) -> dict[str, str]:
    """Where a project's audit keeps its catalog, plan, review packages, index and report: in ``base``, else within the project."""
    base = base.rstrip("/") if base else f"{root.rstrip('/')}/.audit_workspace"
    names = {"catalog": "catalog.json", "plan": "plan", "candidates": "pending_cands", "index": "index", "report": "audit_report.md"}
    return {"base": base} | {k: f"{base}/{v}" for k, v in names.items()}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file for people to read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
