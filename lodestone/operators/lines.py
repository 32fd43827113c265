"""Lines, symbols and what encloses them: as-of lookups by window, never a line-by-line join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S


#: Rows that a task takes of lines gathered by file; the number of tasks grows with the rows.
ROWS_A_TASK = 1_000_000


def by_file(rows: DataFrame, file: str, n_rows: int, a_task: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` dealt by ``file``, at most about ``a_task`` a task: groupings and windows by file then need no other shuffle."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n_rows // a_task)), file)


def explode_lines(files: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """``keys, line_no, line``; line numbers from 1."""
    return files.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def parse_symbol_listing(listing: DataFrame, file: str = "file", row: str = "row", numbered: bool = False) -> DataFrame:
    """Functions and methods of listing rows such as ``- `name` (function) - :12``.

    Without a number the line is 1; with ``numbered``, as coverage reads a listing, such rows are left out.
    """
    shape = r"^\s*-\s+`([^`]+)`\s+\((function|method)\)(?:\s+\([^)]*\))?\s+\S+\s+:(\S*)\s*$"
    got = listing.where(F.col(row).rlike(shape))
    number = F.regexp_extract(row, shape, 3)
    if numbered:
        got = got.where(number.rlike(r"^\d+$"))
    return got.select(file, F.regexp_extract(row, shape, 1).alias("name"), F.when(number.rlike(r"^\d+$"), number.cast("int")).otherwise(1).alias("line"))


def only_if(value: Column, wanted=lambda x: x.isNotNull()) -> Column:
    """A row for a ``wanted`` value, none for another; unlike a filter above it, the value is worked out once."""
    return F.explode(F.filter(F.array(value), wanted))


def symbols_of(lines: DataFrame, file: str = "file", strict: bool = True) -> DataFrame:
    """Symbols found by header patterns in ``lines(file, line_no, line)``."""
    return lines.select(file, only_if(S.header_name(F.col("line"), strict)).alias("name"), F.col("line_no").cast("int").alias("line"))


def first_symbols(symbols: DataFrame, order: list[Column]) -> DataFrame:
    """One row a (file, name): the first in the given order."""
    w = Window.partitionBy("file", "name").orderBy(*order)
    return symbols.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def symbol_sources(symbols: DataFrame, lines: DataFrame, file: str = "file") -> DataFrame:
    """Each symbol with its source: the lines from its own to before the next symbol of the file."""
    starts = symbols.select(F.col(file), F.col("line").cast("long").alias("line_no"), F.col("name").alias("__name")).dropDuplicates([file, "line_no"])
    marked = lines.select(file, "line_no", F.col("line").alias("__text")).join(starts, [file, "line_no"], "left")
    w = Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("__name").isNotNull(), F.struct(F.col("__name").alias("name"), F.col("line_no").alias("line"))), ignorenulls=True).over(w)
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col("__text").alias("t")))), lambda x: x["t"]), "\n")
    owned = marked.withColumn("__head", head).where("__head is not null")
    return owned.groupBy(file, F.col("__head.name").alias("name"), F.col("__head.line").cast("int").alias("line")).agg(code.alias("code"))


def enclosing_header(lines: DataFrame, file: str = "file", exclude: str | None = None, strict: bool = False) -> DataFrame:
    """``lines`` with ``enclosing``: the nearest header at or above the line, other than ``exclude``,
    or the module-level label."""
    header = S.header_name(F.col("line"), strict)
    if exclude is not None:
        header = F.when(header != exclude, header)
    w = Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(header, ignorenulls=True).over(w)
    return lines.withColumn("enclosing", F.coalesce(last, S.module_label(F.col(file), F.col("line_no"))))


def headers_of(lines: DataFrame, file: str = "file", strict: bool = False) -> DataFrame:
    """``file, line_no, name`` of the lines that are headers."""
    return lines.select(file, "line_no", only_if(S.header_name(F.col("line"), strict)).alias("name"))


def headed(marks: DataFrame, headers: DataFrame, file: str = "file", avoid: str | None = None) -> DataFrame:
    """``marks(file, line_no, ...)`` with ``enclosing``: the nearest of ``headers(file, line_no, name)`` at or above.

    Where that has the name in the column ``avoid`` of the mark, the search goes on upward past it;
    a mark without any header left has the module-level label. Only headers and marks go through the
    window, which carries the last header's name and the last one before it that differs.
    """
    extra = [c for c in marks.columns if c not in (file, "line_no")]
    empty = [F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in extra]
    rows = headers.select(file, F.col("line_no").cast("long"), F.lit(0).alias("__mark"), F.col("name").alias("__name"), *empty)
    rows = rows.unionByName(marks.select(file, F.col("line_no").cast("long"), F.lit(1).alias("__mark"), F.lit(None).cast("string").alias("__name"), *extra))
    w = Window.partitionBy(file).orderBy("line_no", "__mark")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__before", F.last("__name", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    turned = F.col("__name").isNotNull() & ~F.col("__name").eqNullSafe(F.col("__before"))
    other = F.last(F.when(turned, F.struct(F.col("__before").alias("name"))), ignorenulls=True).over(so_far)
    rows = rows.withColumn("__last", F.last("__name", ignorenulls=True).over(so_far)).withColumn("__other", other).where("__mark = 1")
    nearest = F.col("__last") if avoid is None else F.when(F.col("__last") == F.col(avoid), F.col("__other.name")).otherwise(F.col("__last"))
    return rows.select(file, "line_no", *extra, F.coalesce(nearest, S.module_label(F.col(file), F.col("line_no"))).alias("enclosing"))


def owning_symbol(hits: DataFrame, symbols: DataFrame, file: str = "file", order: str = "listing_ord") -> DataFrame:
    """``hits(file, line_no, ...)`` with the owner ``function``: the last symbol that starts at or before
    the line, of equal starts the later listed. Hits above the first symbol are dropped."""
    extra = [c for c in hits.columns if c not in (file, "line_no")]
    marks = symbols.select(
        file, F.col("line").cast("long").alias("line_no"), F.lit(0).alias("__hit"), F.col(order).cast("long").alias("__ord"), F.col("name").alias("__name"),
        *(F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in extra),
    )
    rows = hits.select(file, F.col("line_no").cast("long").alias("line_no"), F.lit(1).alias("__hit"), F.lit(0).cast("long").alias("__ord"), F.lit(None).cast("string").alias("__name"), *extra)
    w = Window.partitionBy(file).orderBy("line_no", "__hit", "__ord").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last("__name", ignorenulls=True).over(w)
    return marks.unionByName(rows).withColumn("function", owner).where("__hit = 1 and function is not null").select(file, "line_no", "function", *extra)


def coverage_gaps(hits: DataFrame, symbols: DataFrame, recalled: DataFrame, file: str = "file") -> DataFrame:
    """Hits whose owner is not among ``recalled(file, function)``; a row for each hit line."""
    return owning_symbol(hits, symbols, file).join(recalled.select(file, "function").distinct(), [file, "function"], "left_anti")


def usages(lines: DataFrame, signals: DataFrame | list[str], file: str = "file", limit: int | None = 40) -> DataFrame:
    """``file, signal, enclosing, line_no``: first use of each signal in each enclosing function.

    A line that defines the signal itself is no use of it. ``limit`` counts per signal.
    """
    signals = list(signals)
    if not signals:
        return lines.select(file, F.lit("").alias("signal"), F.lit("").alias("enclosing"), "line_no").limit(0)
    own = S.defined_name(F.col("line"))
    hits = F.array_compact(
        F.array(
            *(
                F.when(
                    S.signal_hit(F.col("line"), s)
                    & (F.lit(True) if S.is_regex_signal(s) else ~F.coalesce(F.contains(F.lit(s), own), F.lit(False))),
                    F.lit(s),
                )
                for s in signals
            )
        )
    )
    # one expression over all signals decides for most lines; only hits and headers go on, through one window
    found = F.when(S.any_signal_hit(F.col("line"), signals), hits)
    both = F.struct(S.header_name(F.col("line")).alias("name"), found.alias("hits"))
    rows = lines.select(file, F.col("line_no").cast("long").alias("line_no"), only_if(both, lambda x: x["name"].isNotNull() | x["hits"].isNotNull()).alias("__at")).select(file, "line_no", F.col("__at.name").alias("__name"), F.col("__at.hits").alias("__hits"))
    above = Window.partitionBy(file).orderBy("line_no", F.col("__name").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.coalesce(F.last("__name", ignorenulls=True).over(above), S.module_label(F.col(file), F.col("line_no")))
    used = rows.withColumn("enclosing", owner).where("__hits is not null").select(file, "line_no", "enclosing", F.explode("__hits").alias("signal"))
    first = used.groupBy(file, "signal", "enclosing").agg(F.min("line_no").alias("line_no"))
    if limit is None:
        return first
    w = Window.partitionBy("signal").orderBy(file, "line_no")
    return first.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")
