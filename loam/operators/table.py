"""Versioned tables: appends, reads of any version, copy-on-write changes, upkeep, import."""

from __future__ import annotations

import contextlib
import datetime as dt
import random
import re
import threading
import time
from collections import defaultdict, deque
from concurrent.futures import Future
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.plans.expr import Expr, parse
from loam.plans.query import Query
from loam.plans.types import ConcurrentModification, LoamError, TableSpec, VersionExpired, constant, literal
from loam.sources import files as files_
from loam.sources.log import File, Log
from loam.sources.store import store_for

RETRIES = 10
PATH = "__loam_path"
HISTORY = "version bigint, operation string, params string, committed_at timestamp_ntz"


class Table:
    """A table below a root folder. Values of this class hold no data and may be many for one table."""

    def __init__(self, spark: SparkSession, root: str, spec: TableSpec) -> None:
        self.spark, self.spec, self.store = spark, spec, store_for(spark, root)
        self.log = Log(self.store, spec)
        self.log.ensure()
        self._buffer = WriteBuffer(self, spec.write_buffer_ms) if spec.write_buffer_ms else None
        self._compacting: set[tuple] = set()
        self._threads: list[threading.Thread] = []
        self._lock = threading.Lock()
        #: The newest errors of auto-compaction, which no append raises.
        self.compaction_errors: deque[Exception] = deque(maxlen=100)

    # reading

    def query(self) -> Query:
        return Query(self)

    def read(self, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        return self.query().at(version, as_of).df()

    def live_files(self, condition: Expr, version: int | None = None, as_of: dt.datetime | None = None) -> list[File]:
        """The files of a version that may match; VersionExpired if vacuum took one of them."""
        resolved = self.log.resolve(version, as_of)
        found = self.log.files(condition, resolved)
        if resolved < self.log.low_water():
            gone = self.log.expired(resolved)
            if any(f.path in gone for f in found):
                raise VersionExpired(f"files of version {resolved} of {self.spec.name} were vacuumed")
        return found

    def read_files(self, files: list[File], path_as: str | None = None) -> DataFrame:
        return files_.read_files(self.spark, self.spec, self.store, files, path_as)

    def version(self) -> int:
        return self.log.latest()

    def snapshot(self, version: int | None = None) -> list[File]:
        return sorted(self.log.snapshot(self.log.resolve(version)).values(), key=lambda f: f.path)

    def history(self, limit: int = 50) -> DataFrame:
        """The newest commits first: version, operation, params as JSON text, committed_at."""
        from loam.sources.store import dumps

        newest = self.log.latest()
        rows = [self.log.record(v) for v in range(newest, max(0, newest - limit), -1)]
        rows = [(r["version"], r["operation"], dumps(r["params"]), dt.datetime.fromisoformat(r["committed_at"])) for r in rows]
        return self.spark.createDataFrame(rows, HISTORY).orderBy(F.col("version").desc())

    def totals(self, version: int | None = None) -> dict[str, int]:
        """Files, rows and bytes of a version, from the log alone."""
        live = self.snapshot(version)
        return {"files": len(live), "rows": sum(f.rows for f in live), "bytes": sum(f.size for f in live)}

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Rows that differ between two versions, with _change insert or delete; files in both are never read."""
        old, new = self.log.snapshot(self.log.resolve(start)), self.log.snapshot(self.log.resolve(end))
        if (gone := self.log.expired(self.log.resolve(start))) & (set(old) - set(new)):
            raise VersionExpired(f"{len(gone)} files of version {start} were vacuumed")
        before = self.read_files([f for p, f in old.items() if p not in new])
        after = self.read_files([f for p, f in new.items() if p not in old])
        maps = [f for f in self.spec.schema if _has_map(f.dataType)]  # no order and no equality in Spark
        before, after = (x.withColumns({f.name: _listed(F.col(f"`{f.name}`"), f.dataType) for f in maps}) for x in (before, after))
        found = after.exceptAll(before).withColumn("_change", F.lit("insert")).union(before.exceptAll(after).withColumn("_change", F.lit("delete")))
        return found.withColumns({f.name: _mapped(F.col(f"`{f.name}`"), f.dataType) for f in maps})

    # writing

    def create(self, **values: object) -> int | None:
        """Appends one row."""
        nested = (T.StructType, T.ArrayType, T.MapType, T.BinaryType)
        given = {f.name: values.pop(f.name, None) for f in self.spec.schema}
        row = tuple(v if isinstance(self.spec.type_of(c), nested) else literal(v, self.spec.type_of(c)) for c, v in given.items())
        if values:
            raise ValueError(f"{self.spec.name} has no column {', '.join(values)}")
        return self.append(self.spark.createDataFrame([row], self.spec.schema))

    def append(self, df: DataFrame) -> int | None:
        """Adds df's rows in one commit; the new version, or None (and no commit) without rows.

        With write_buffer_ms, appends that come within that time share a commit, and all get its version.
        """
        return self._buffer.append(df) if self._buffer else self.append_now(df)

    def append_now(self, df: DataFrame, **more: object) -> int | None:
        added = files_.stage(df, self.spec, self.store)
        if not added and "txn" not in more:
            return None
        try:
            version = self.log.commit("append", {"row_count": sum(f.rows for f in added)}, added, **more)
        except LoamError:  # raised before anything is published; other errors may come after it
            self._discard(added)
            raise
        self._auto_compact(added)
        return version

    def _discard(self, files: list[File]) -> None:
        """Deletes staged files that no version will name; what can't be deleted now is left to vacuum."""
        for f in files:
            with contextlib.suppress(Exception):
                self.store.delete(f.path)

    def backfill_statistics(self) -> int | None:
        """Gathers what files lack of the declared stats_columns (declared later, say), in one commit; its version, or None.

        Files stay where they are; one pass reads the columns that the statistics need.
        """
        lacking = [f for f in self.log.snapshot().values() if any(c not in f.stats and not (f.inject and c in self.spec.partition_by) for c in self.spec.stats_columns)]
        if not lacking:
            return None
        with files_.settings(self.spark, self.store.listing):
            read = self.spark.read.schema(self.spec.schema).parquet(*[files_.escaped(self.store.url(f.path)) for f in lacking])
        found = {name: f.stats for name, f in files_.describe(read, self.spec, self.store)[0]}
        added = [replace(f, stats=found.get(f.path, f.stats)) for f in lacking]
        return self.log.commit("backfill", {"file_count": len(added)}, added, [f.path for f in added])

    def info(self) -> DataFrame:
        """option, value: the declaration, and where the table is, as text."""
        return self.spark.createDataFrame(sorted({**self.spec.options(), "root": self.store.root, "version": str(self.version())}.items()), "option string, value string")

    # changing

    def delete_where(self, *parts: object, **equals: object) -> dict:
        """Removes the rows that match; version, files_rewritten, rows_affected. Nothing matching: no commit."""
        return self._rewrite("delete", parse(*parts, **equals), None)

    def update_where(self, condition: object, **changes: object) -> dict:
        """Sets columns to values where the condition holds; rows may move to other partitions."""
        if not changes:
            raise ValueError("nothing to change")
        return self._rewrite("update", parse(condition), {c: literal(v, self.spec.type_of(c)) for c, v in changes.items()})

    def delete_row(self, **key: object) -> dict:
        return self.delete_where(self._key(key))

    def update_row(self, key: dict, **changes: object) -> dict:
        return self.update_where(self._key(key), **changes)

    def _key(self, key: dict) -> dict:
        if not self.spec.primary_key or set(key) != set(self.spec.primary_key):
            raise ValueError(f"the primary key is {self.spec.primary_key}")
        return key

    def _rewrite(self, operation: str, condition: Expr, changes: dict | None) -> dict:
        for attempt in range(RETRIES):
            try:
                return self._rewrite_once(operation, condition, changes)
            except ConcurrentModification:
                if attempt == RETRIES - 1:
                    raise
                time.sleep(random.random() * 0.05 * 2**attempt)
        raise AssertionError

    def _rewrite_once(self, operation: str, condition: Expr, changes: dict | None) -> dict:
        version = self.log.latest()
        candidates = self.log.files(condition, version)
        predicate = F.coalesce(condition.column(self.spec), F.lit(False))
        if changes is None and condition.columns() <= set(self.spec.partition_by):
            hits = self._whole(candidates, predicate)
        else:
            hits = self._hits(candidates, predicate)
        touched = [f for f in candidates if hits.get(f.path)]
        affected = sum(hits.values())
        if not touched:
            return {"version": version, "files_rewritten": 0, "rows_affected": 0}
        partly = [f for f in touched if hits[f.path] < f.rows] if changes is None else touched
        rows = self.read_files(partly)
        if changes is None:
            kept = rows.where(~predicate)
        else:
            new = {c: constant(v, self.spec.type_of(c)) for c, v in changes.items()}
            kept = rows.select([F.when(predicate, new[f.name]).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in self.spec.schema])
        added = files_.stage(kept, self.spec, self.store) if partly else []
        params = {"rows_affected": affected, "files_rewritten": len(touched)}
        try:
            return {"version": self.log.commit(operation, params, added, [f.path for f in touched])} | params
        except LoamError:
            self._discard(added)
            raise

    def _whole(self, files: list[File], predicate: Column) -> dict[str, int]:
        """Files that match whole, judged by their partition values: no data is read."""
        columns = self.spec.partition_by
        schema = T.StructType([T.StructField(PATH, T.StringType()), *[T.StructField(c, self.spec.schema[c].dataType) for c in columns]])
        rows = [(f.path, *f.values(self.spec, columns)) for f in files]
        matching = {r[PATH] for r in self.spark.createDataFrame(rows, schema).where(predicate).select(PATH).collect()} if rows else set()
        return {f.path: f.rows for f in files if f.path in matching}

    def _hits(self, files: list[File], predicate: Column) -> dict[str, int]:
        """How many rows match in each file: one pass over the columns that the condition needs."""
        if not files:
            return {}
        counted = self.read_files(files, PATH).where(predicate).groupBy(PATH).count().collect()
        return {files_.local_name(self.store, r[PATH]): r["count"] for r in counted}

    # upkeep

    def optimize(self, min_files: int = 4, partition: dict | None = None, only: set[tuple] | None = None) -> dict:
        """Joins small files (under half the target size) of partitions that have min_files of them or more.

        partition: values of partition columns that narrow it down; only: the partitions' whole values, as tuples.

        All partitions are written by one job; each is committed by itself, so a conflict in one leaves the others
        joined; such partitions are tried again, then counted as partitions_skipped.
        """
        small = self.spec.target_file_size_mb * 2**20 / 2
        wanted = None if partition is None else {c: literal(v, self.spec.type_of(c)) for c, v in partition.items()}
        if wanted and (unknown := set(wanted) - set(self.spec.partition_by)):
            raise ValueError(f"not partitioned by {', '.join(unknown)}")
        result = {"partitions_compacted": 0, "files_removed": 0, "files_added": 0, "partitions_skipped": 0}
        left: set[tuple] | None = None
        for _ in range(RETRIES):
            groups: dict[tuple, list[File]] = defaultdict(list)
            for f in self.log.snapshot().values():
                values = dict(zip(self.spec.partition_by, f.values(self.spec, self.spec.partition_by), strict=True))
                if f.size < small and (wanted is None or all(values[c] == v for c, v in wanted.items())) and (only is None or tuple(values.values()) in only):
                    groups[tuple(values.values())].append(f)
            groups = {k: v for k, v in groups.items() if len(v) >= min_files and (left is None or k in left)}
            if not groups:
                break
            added: dict[tuple, list[File]] = defaultdict(list)
            with files_.settings(self.spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(self.spec.target_file_size_mb * 2**20))}):
                for f in files_.stage(self.read_files([f for g in groups.values() for f in g]), self.spec, self.store):
                    added[f.values(self.spec, self.spec.partition_by)].append(f)
            left = set()
            for key, old in groups.items():
                new = added[key]
                try:
                    self.log.commit("optimize", {"removed": len(old), "added": len(new)}, new, [f.path for f in old])
                    result["partitions_compacted"] += 1
                    result["files_removed"] += len(old)
                    result["files_added"] += len(new)
                except ConcurrentModification:
                    left.add(key)
                    self._discard(new)
            if not left:
                break
        result["partitions_skipped"] = len(left or ())
        return result

    def vacuum(self, retention_hours: float | None = None, dry_run: bool = False) -> dict:
        """Deletes files whose removal is older than the retention, and files as old that no commit ever named.

        Versions that need removed files raise VersionExpired from then on. What can't be deleted now is tried next
        time. Nothing is committed.
        """
        hours = self.spec.vacuum_retention_hours if retention_hours is None else retention_hours
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        limit = now - dt.timedelta(hours=hours)
        latest, low = self.log.latest(), self.log.low_water()
        state = self.log.state(latest)
        old = self.log.resolve(as_of=limit)
        removed = [(v, p) for p, v in sorted(state.removed.items()) if v <= old]
        folders: dict[str, set[str]] = {}
        for _, path in removed:
            parent = path.rsplit("/", 1)[0]
            if parent not in folders:
                folders[parent] = set(self.store.names(parent))
        present = [p for _, p in removed if p.rsplit("/", 1)[1] in folders[p.rsplit("/", 1)[0]]]
        orphans = self._orphans(limit.replace(tzinfo=dt.UTC).timestamp(), hours > 0)
        if dry_run:
            return {"candidates": present + orphans}
        if removed and max(v for v, _ in removed) > low:
            self.store.replace(f"{self.log.folder}/vacuumed.txt", str(max(v for v, _ in removed)))
        deleted = 0
        for path in present + orphans:
            try:
                self.store.delete(path)
                deleted += 1
            except Exception:  # noqa: BLE001, S112 - stays a candidate
                continue
        if removed and deleted == len(present) + len(orphans):
            self.store.replace(f"{self.log.folder}/swept.txt", str(max(low, *(v for v, _ in removed))))
        return {"deleted": deleted, "candidates": len(present) + len(orphans)}

    def _orphans(self, before: float, wanted: bool) -> list[str]:
        """Files of this table's making, changed last before a time, that commits which failed have left.

        Asked for without a retention there are none: files that a writer has staged but not yet committed look alike.
        """
        if not wanted:
            return []
        state, own = self.log.state(), re.compile(rf"{self.spec.name}/(_staging/|(.*/)?part-[0-9a-f]{{32}}\.parquet$)")
        return sorted(p for p, changed in self.store.walk(self.spec.name) if changed < before and own.match(p) and p not in state.live and p not in state.removed)

    def _auto_compact(self, added: list[File]) -> None:
        """Joins small files of the partitions that were added to, by one job. The append is committed: nothing is raised."""
        threshold = self.spec.auto_compact_threshold
        if not threshold:
            return
        with self._lock:
            keys = {f.values(self.spec, self.spec.partition_by) for f in added} - self._compacting
            self._compacting |= keys
        if not keys:
            return
        if self.spec.auto_compact_async:
            thread = threading.Thread(target=self._compact, args=(threshold, keys), daemon=True)
            with self._lock:
                self._threads = [t for t in self._threads if t.is_alive()] + [thread]
            thread.start()
        else:
            self._compact(threshold, keys)

    def _compact(self, threshold: int, keys: set[tuple]) -> None:
        try:
            self.optimize(threshold, only=keys)
        except Exception as error:  # noqa: BLE001 - told by compaction_errors; files stay as they are
            self.compaction_errors.append(error)
        finally:
            with self._lock:
                self._compacting -= keys

    def wait_for_compaction(self) -> None:
        """Returns when the auto-compactions begun so far by this table are done."""
        for thread in list(self._threads):
            thread.join()

    # import

    def import_existing(self, prefix: str, rewrite_mixed: bool = False) -> int:
        """Takes Parquet files below a folder of the root into the table where they are; the new version.

        Rows, sizes and statistics come from one pass. Partition columns that files lack are read from k=v folders.
        Files that the table knows are passed over; no new file is an error. So is a file whose rows belong to more
        than one partition, as one value must hold for a file; with rewrite_mixed such files stay out of the table and
        their rows are written into files of its own.
        """
        prefix = prefix.strip("/")
        if not prefix:
            raise ValueError("import needs a folder")
        with files_.settings(self.spark, self.store.listing):
            read = self.spark.read.schema(self.spec.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            described, mixed = files_.describe(read.parquet(self.store.url(prefix)), self.spec, self.store)
        state = self.log.state()
        known = {*state.live, *state.removed}
        found = [f for _, f in described if f.path not in known and "/_" not in f.path]
        mixed = sorted(p for p in mixed if "/_" not in p)
        if mixed and not rewrite_mixed:
            raise LoamError(f"{len(mixed)} files below {prefix} hold rows of several partitions, {mixed[0]} for one")
        if not found and not mixed:
            raise LoamError(f"no new Parquet files below {prefix}")
        made = files_.stage(self.read_files([File(p, 0, 0) for p in mixed]), self.spec, self.store) if mixed else []
        try:
            return self.log.commit("import", {"file_count": len(found) + len(made), "source_prefix": prefix}, found + made)
        except LoamError:
            self._discard(made)
            raise


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind)


def _listed(column: Column, kind: T.DataType) -> Column:
    """The value with every map in it as entries in the order of their keys, which can be compared."""
    if not _has_map(kind):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _listed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), _listed(e["value"], kind.valueType).alias("value"))))
    return F.when(column.isNotNull(), F.struct(*[_listed(column[f.name], f.dataType).alias(f.name) for f in kind]))


def _mapped(column: Column, kind: T.DataType) -> Column:
    """_listed() reversed."""
    if not _has_map(kind):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _mapped(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(column, lambda e: F.struct(e["key"].alias("key"), _mapped(e["value"], kind.valueType).alias("value"))))
    return F.when(column.isNotNull(), F.struct(*[_mapped(column[f.name], f.dataType).alias(f.name) for f in kind]))


class WriteBuffer:
    """Appends that come within a window go into one commit; all callers wait for it and share its outcome."""

    def __init__(self, table: Table, window_ms: int) -> None:
        self.table, self.window, self.lock = table, window_ms / 1000, threading.Lock()
        self.waiting: list[DataFrame] = []
        self.result: Future | None = None

    def append(self, df: DataFrame) -> int | None:
        shaped = files_.shaped(df, self.table.spec)
        with self.lock:
            first = self.result is None
            if first:
                self.result = Future()
            self.waiting.append(shaped)
            result = self.result
        if first:
            time.sleep(self.window)
            with self.lock:
                frames, self.waiting, self.result = self.waiting, [], None
            try:
                union = frames[0]
                for frame in frames[1:]:
                    union = union.unionByName(frame)
                result.set_result(self.table.append_now(union))
            except BaseException as error:  # noqa: BLE001 - every caller gets it
                result.set_exception(error)
        return result.result()
