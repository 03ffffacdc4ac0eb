"""Materialized views: tables made by a query from others, refreshed whole or by the partitions that changed."""

from __future__ import annotations

import contextlib
import functools
import operator
import random
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loam.operators.table import Table
from loam.plans.expr import Constant
from loam.plans.types import ConcurrentModification, LoamError, ViewIsReadOnly, ViewSpec
from loam.sources import files as files_
from loam.sources.log import File

RETRIES = 10


class View(Table):
    """A view: read, optimized and vacuumed like a table, written by refresh alone."""

    def __init__(self, spark: SparkSession, root: str, spec: ViewSpec) -> None:
        super().__init__(spark, root, spec)

    def append(self, df: DataFrame) -> int | None:
        raise ViewIsReadOnly(self.spec.name)

    def create(self, **values: object) -> int | None:
        raise ViewIsReadOnly(self.spec.name)

    def delete_where(self, *parts: object, **equals: object) -> dict:
        raise ViewIsReadOnly(self.spec.name)

    def update_where(self, condition: object, **changes: object) -> dict:
        raise ViewIsReadOnly(self.spec.name)

    def import_existing(self, prefix: str, rewrite_mixed: bool = False) -> int:
        raise ViewIsReadOnly(self.spec.name)

    def refresh(self, strategy: str | None = None) -> dict | str:
        """Brings the view up to its sources' newest versions.

        "recompute" makes all of it anew, always. "partition_incremental" makes the partitions anew that source files
        added or removed since the last refresh belong to; without new versions it returns "up_to_date", and if no
        file changed it only records the versions. Else a summary. Sources are read at fixed versions, and what was
        read is recorded with the files in one commit.
        """
        strategy = strategy or self.spec.refresh
        if strategy not in ("recompute", "partition_incremental"):
            raise ValueError(f"no refresh strategy: {strategy!r}")
        if strategy == "partition_incremental":
            self.spec.check_alignment()
        for attempt in range(RETRIES):
            try:
                return self._refresh_once(strategy)
            except ConcurrentModification:
                if attempt == RETRIES - 1:
                    raise
                time.sleep(random.random() * 0.05 * 2**attempt)
        raise AssertionError

    def _refresh_once(self, strategy: str) -> dict | str:
        spec = self.spec
        targets = {alias: source.log.latest() for alias, source in spec.sources.items()}
        before, base = self.log.watermarks(), self.log.latest()
        if strategy == "recompute":
            changed = None
        else:
            if all(targets[a] == before.get(a, -1) for a in targets):
                return "up_to_date"
            changed = self._changed(before, targets)
            if not changed:
                version = self.log.commit("refresh_watermark", {}, watermarks=targets)
                return self._summary(version, strategy, 0, [], [], targets)
        kept = self._of(self.log.snapshot(base).values(), changed)
        added = files_.stage(self._result(targets, changed), spec, self.store)
        rows = sum(f.rows for f in added)
        operation, params = ("refresh_full", {"rows": rows}) if changed is None else ("refresh_incremental", {"rows": rows, "partitions": len(changed)})
        try:
            version = self.log.commit(operation, params, added, [f.path for f in kept], watermarks=targets)
        except LoamError:
            self._discard(added)
            raise
        count = len({f.values(spec, spec.partition_by) for f in added}) if changed is None else len(changed)
        return self._summary(version, strategy, count, added, kept, targets)

    def _summary(self, version: int, strategy: str, partitions: int, added: list[File], removed: list[File], targets: dict) -> dict:
        return {"view_version": version, "strategy": strategy, "partitions": partitions, "rows_written": sum(f.rows for f in added), "files_added": len(added), "files_removed": len(removed), "watermarks": targets}

    def _changed(self, before: dict, targets: dict) -> set[tuple]:
        """The view's partitions that source files added or removed since belong to."""
        out: set[tuple] = set()
        for alias, source in self.spec.sources.items():
            old = source.log.snapshot(before[alias]) if alias in before else {}
            new = source.log.snapshot(targets[alias])
            out |= {f.values(source.spec, self.spec.partition_by) for f in [*old.values(), *new.values()] if (f.path in old) != (f.path in new)}
        return out

    def _of(self, files: object, partitions: set[tuple] | None, source: Table | None = None) -> list[File]:
        spec = (source or self).spec
        return [f for f in files if partitions is None or f.values(spec, self.spec.partition_by) in partitions]

    def _result(self, targets: dict, changed: set[tuple] | None) -> DataFrame:
        """The query over the sources' files of the targeted versions that belong to the changed partitions."""
        session = self.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            session.conf.set(key, self.spark.conf.get(key))
        for name, function in self.spec.functions.items():
            session.udf.register(name, function)
        for alias, source in self.spec.sources.items():
            live = source.live_files(Constant(True), targets[alias])
            files = self._of(live, changed, source)
            files_.read_files(session, source.spec, source.store, files).createOrReplaceTempView(alias)
        made = session.sql(self.spec.query) if isinstance(self.spec.query, str) else self.spec.query(session)
        if changed is None:
            return made
        # whatever the query makes of its sources' rows, only the changed partitions are replaced
        columns = self.spec.partition_by
        wanted = session.createDataFrame(sorted(changed, key=str), T.StructType([T.StructField(f"__{c}", self.spec.type_of(c)) for c in columns]))
        same = [made[c].cast(self.spec.type_of(c)).eqNullSafe(wanted[f"__{c}"]) for c in columns]
        return made.join(wanted, functools.reduce(operator.and_, same), "left_semi")


def refresh_all(views: list[View], strategy: str | None = None) -> dict[str, dict | str]:
    """Refreshes views after the views that they read."""
    left, done = list(views), {}
    while left:
        names = {v.spec.name for v in left}
        ready = [v for v in left if not any(s.spec.name in names and s is not v for s in v.spec.sources.values())]
        if not ready:
            raise ValueError("views read each other")
        for view in ready:
            done[view.spec.name] = view.refresh(strategy)
        left = [v for v in left if v not in ready]
    return done


class RefreshWorker:
    """Refreshes a view when it gets stale, and soon after notify(); a burst of calls is one refresh.

    A refresh that fails is told in `errors` (the newest hundred) and to `on_error`, if given; the worker goes on, and
    tries again when the view is stale or notify() is called the next time.
    """

    def __init__(self, view: View, max_staleness: float | None = None, min_interval_ms: int = 1000, on_error: Callable[[Exception], None] | None = None) -> None:
        self.view, self.interval, self.on_error = view, min_interval_ms / 1000, on_error
        self.staleness = max_staleness if max_staleness is not None else view.spec.max_staleness
        self.refreshed, self.errors = 0, deque(maxlen=100)
        self._wake, self._stopped = threading.Event(), threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> RefreshWorker:
        self._thread.start()
        return self

    def notify(self) -> None:
        self._wake.set()

    def stop(self) -> None:
        self._stopped.set()
        self._wake.set()
        self._thread.join()

    def _run(self) -> None:
        while not self._stopped.is_set():
            self._wake.wait(self.staleness)
            if self._stopped.is_set():
                return
            self._stopped.wait(self.interval)  # what comes meanwhile is part of this refresh
            self._wake.clear()
            if self._stopped.is_set():
                return
            try:
                self.view.refresh()
                self.refreshed += 1
            except Exception as error:  # noqa: BLE001 - whatever it is, the next refresh may do
                self.errors.append(error)
                if self.on_error:
                    with contextlib.suppress(Exception):
                        self.on_error(error)
