"""Writing and reading data files: partitioned, sorted, with statistics of every file by one aggregation."""

from __future__ import annotations

import contextlib
import threading
import urllib.parse
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.plans.types import LoamError, TableSpec, encode
from loam.sources.log import File
from loam.sources.store import Store

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Characters that stand in a folder's name as they are.
_SAFE = " _.-+@,()"
#: Types that Spark can change in place in an aggregation's hashed rows.
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Files that a task of an unsorted table has open at once; with more partition values it sorts the rest of its rows.
WRITERS = 16


_held: dict[tuple, list] = {}
_holding = threading.Lock()


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Sets options of a session for a while. Threads may overlap; the last to leave puts back what was there."""
    keys = [(id(spark._jsparkSession), k) for k in wanted]
    with _holding:
        for key in keys:
            if key not in _held:
                _held[key] = [spark.conf.get(key[1], None), 0]
            _held[key][1] += 1
            spark.conf.set(key[1], wanted[key[1]])
    try:
        yield
    finally:
        with _holding:
            for key in keys:
                _held[key][1] -= 1
                if not _held[key][1]:
                    before, _ = _held.pop(key)
                    spark.conf.unset(key[1]) if before is None else spark.conf.set(key[1], before)


def shaped(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df with the table's columns, in order and cast; missing ones null. Other columns are refused."""
    if unknown := [c for c in df.columns if c not in spec.schema.fieldNames()]:
        raise ValueError(f"{spec.name} has no column {', '.join(unknown)}")
    return df.select([(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema])


def folder(partition: dict) -> str:
    """k=v/ for each partition column by name; values are escaped."""
    shown = {k: NO_VALUE if v is None or v == "" else urllib.parse.quote(str(v), safe=_SAFE) for k, v in partition.items()}
    return "".join(f"{k}={shown[k]}/" for k in sorted(shown))


def partition_of(path: str, columns: tuple[str, ...]) -> dict[str, str | None]:
    """Values that the k=v parts of a path give to partition columns, as text."""
    found = (part.split("=", 1) for part in path.split("/")[:-1] if "=" in part)
    return {k: None if v == NO_VALUE else urllib.parse.unquote(v) for k, v in found if k in columns}


def _file_path() -> Column:
    return F.col("_metadata.file_path")


def local_name(store: Store, url: str) -> str:
    """A file's path relative to the root, from Spark's encoded URL."""
    path, root = urllib.parse.unquote(url), store.root
    at = path.find(root + "/")
    if at < 0:
        raise ValueError(f"{path} is not below {root}")
    return path[at + len(root) + 1 :]


def describe(df: DataFrame, spec: TableSpec, store: Store) -> tuple[list[tuple[str, File]], list[str]]:
    """For each file that df reads: rows, size, partition values, minimum, maximum and null count.

    Then the names of files whose rows belong to more than one partition: no values can be told of those. One
    aggregation that reads only the columns it needs; one row a file reaches the driver, which holds the manifest.
    """
    parts = [f(_value(c, spec)).alias(f"{p}{i}") for i, c in enumerate(spec.partition_by) for p, f in (("p", F.min), ("q", F.max))]
    some = [F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(spec.partition_by)]
    stats = []
    for i, c in enumerate(spec.stats_columns):
        column = _value(c, spec)
        stats += [F.min(column).alias(f"a{i}"), F.max(column).alias(f"b{i}"), F.count(column).alias(f"n{i}")]
    kinds = [spec.schema[c].dataType for c in (*spec.partition_by, *spec.stats_columns)]
    # for a minimum of text and the like Spark would sort all rows by file, as its hashed rows have fixed lengths; an
    # aggregate that collects (here nothing) makes it hold a few objects for each file instead
    held = [] if all(isinstance(k, _FIXED) for k in kinds) else [F.collect_set(F.lit(None).cast("int")).alias("none")]
    rows = df.groupBy(_file_path().alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("size"), *parts, *some, *stats, *held).collect()
    out, mixed = [], []
    for r in rows:
        name = local_name(store, r["path"])
        partition, inject, told = {}, False, partition_of(name, spec.partition_by)
        if any(0 < r[f"k{i}"] < r["rows"] or str(r[f"p{i}"]) != str(r[f"q{i}"]) for i in range(len(spec.partition_by))):
            mixed.append(name)
            continue
        for i, c in enumerate(spec.partition_by):
            partition[c] = encode(r[f"p{i}"])
            if not r[f"k{i}"] and told.get(c) is not None:  # only the path has it
                partition[c], inject = encode(_typed(told[c], spec.schema[c].dataType)), True
        about = {c: [encode(r[f"a{i}"]), encode(r[f"b{i}"]), r["rows"] - r[f"n{i}"]] for i, c in enumerate(spec.stats_columns)}
        if inject:  # statistics of a column that the file lacks
            about = {c: v for c, v in about.items() if c not in spec.partition_by}
        out.append((name, File(name, r["size"], r["rows"], partition, about, inject)))
    return out, mixed


def _value(column: str, spec: TableSpec) -> Column:
    """The column as the log keeps it: times without zone, in the session's."""
    value = F.col(f"`{column}`")
    return value.cast("timestamp_ntz") if isinstance(spec.schema[column].dataType, T.TimestampType) else value


def _typed(text: str, kind: T.DataType) -> object:
    """A path's value as one of the column's type."""
    import datetime as dt
    import decimal

    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat(text)
    if isinstance(kind, T.BooleanType):
        return text.lower() == "true"
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(text)
    if isinstance(kind, T.IntegralType):
        return int(text)
    return float(text) if isinstance(kind, (T.FloatType, T.DoubleType)) else text


def stage(df: DataFrame, spec: TableSpec, store: Store) -> list[File]:
    """Writes df into files of the table and tells of them; nobody sees them before a commit does.

    Rows meet by partition values, where Spark's adaptive execution splits large partitions and joins small ones, and
    are sorted within files, if the table is. Else they go to the files of their partitions as they come.
    """
    df = shaped(df, spec)
    # folders are made from copies, as the columns stay in the files; names that no column has
    copies = {f"__loam_{i}": _told_apart(c, spec) for i, c in enumerate(spec.partition_by)}
    df = df.withColumns(copies) if copies else df
    df = df.hint("rebalance", *copies)
    order = [*copies, *[f"`{c}`" for c in spec.sort_within_files]]
    if spec.sort_within_files:
        df = df.sortWithinPartitions(*[F.col(c).asc_nulls_last() if k >= len(copies) else F.col(c) for k, c in enumerate(order)])
    draft = f"{spec.name}/_staging/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    # rows of one partition are in one task (or several, if large) whether small tasks are joined or not, so they aren't
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false"} if copies else {}
    if copies and not spec.sort_within_files:
        wanted["spark.sql.maxConcurrentOutputFileWriters"] = str(WRITERS)
    with settings(df.sparkSession, wanted):
        (writer.partitionBy(*copies) if copies else writer).parquet(store.url(draft))
    try:
        moves, out = [], []
        with settings(df.sparkSession, store.listing):
            read = df.sparkSession.read.schema(spec.schema).option("recursiveFileLookup", "true").parquet(store.url(draft))
        found, mixed = describe(read, spec, store)
        if mixed:
            raise LoamError(f"{mixed[0]} holds rows of several partitions")
        for name, file in found:
            target = f"{spec.name}/{folder(file.partition)}part-{uuid.uuid4().hex}.parquet"
            moves.append((name, target))
            out.append(File(target, file.size, file.rows, file.partition, file.stats))
        store.move_all(moves)
        return out
    finally:
        store.delete(draft)


def _told_apart(column: str, spec: TableSpec) -> Column:
    """The column as a folder's name in the draft; empty text and null get folders of their own."""
    value = F.col(f"`{column}`")
    return F.concat(F.lit("="), value) if isinstance(spec.schema[column].dataType, T.StringType) else value


def read_files(spark: SparkSession, spec: TableSpec, store: Store, files: list[File], path_as: str | None = None) -> DataFrame:
    """The rows of files (path_as: and a column of that name with their file), by the declared schema: a column that a file lacks is null there.

    Paths go in as they are (no base path), so that values come from the files; where only the path has a partition
    value it is taken from there, for all such files in one scan.
    """
    if not files:
        empty = spark.createDataFrame([], spec.schema)
        return empty.withColumn(path_as, F.lit("")) if path_as else empty
    plain, told = [f for f in files if not f.inject], [f for f in files if f.inject]
    path = [_file_path().alias(path_as)] if path_as else []
    out = None
    for group in (plain, told):
        if group:
            with settings(spark, store.listing):
                df = spark.read.schema(spec.schema).parquet(*[escaped(store.url(f.path)) for f in group])
            if group is told:
                df = df.select(*[_from_path(f) if f.name in spec.partition_by else F.col(f"`{f.name}`") for f in spec.schema], *path)
            elif path:
                df = df.select(*[F.col(f"`{f.name}`") for f in spec.schema], *path)
            out = df if out is None else out.unionByName(df)
    return out


def escaped(path: str) -> str:
    """A path as itself where Spark looks for patterns."""
    return "".join("\\" + c if c in "\\{}[]*?" else c for c in path)


def _from_path(f: T.StructField) -> Column:
    coded = F.regexp_extract(_file_path(), f"/{f.name}=([^/]*)/", 1)
    text = F.url_decode(F.replace(F.url_decode(F.replace(coded, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit("%2B")))
    value = F.when((coded != "") & (coded != NO_VALUE), text)
    return F.coalesce(F.col(f"`{f.name}`"), value.cast(f.dataType)).alias(f.name)
