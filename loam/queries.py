"""The catalogue: a query for each operator, and the SQL that says the same over the plain tables."""

from __future__ import annotations

import atexit
import contextlib
import datetime as dt
import decimal
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.columns import asof_join, exact_sum, json_number
from loam.operators.table import Table
from loam.operators.view import View, refresh_all
from loam.plans.expr import field, parse
from loam.plans.types import ConcurrentModification, LoamError, TableSpec, UnsupportedExpression, VersionExpired, ViewIsReadOnly, ViewSpec
from loam.streaming.sink import append_stream, session_counts, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]
SHOWN = "event_id, ts, user_id, event_type, value"
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), False), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()), T.StructField("day", T.DateType()),
])
DAYS = "(SELECT *, CAST(ts AS DATE) AS day FROM events)"
T0, T1 = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12, 6, 30)

_made: dict[tuple, Table] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name; sql is its oracle."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def root(spark: SparkSession) -> str:
    """A fresh folder for tables: below spark.checkpoint.dir, which all executors share, else a temporary one."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="loam-tables-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def spec(name: str = "events", schema: T.StructType = EVENTS, **options: object) -> TableSpec:
    options = {"partition_by": ("event_type", "day"), "sort_within_files": ("ts",), "stats_columns": ("ts", "user_id", "value")} | options
    return TableSpec(name, schema, **options)


def new_events(spark: SparkSession, sf_dir: str, parts: int = 1, **options: object) -> Table:
    """A table of the events, appended in `parts` commits by event_id."""
    table = Table(spark, root(spark), spec(**options))
    df = events(spark, sf_dir)
    for k in range(parts):
        table.append(df.where(F.col("event_id") % parts == k) if parts > 1 else df)
    return table


def shared_events(spark: SparkSession, sf_dir: str, parts: int = 1, **options: object) -> Table:
    """new_events for queries that only read: made once."""
    key = (spark.sparkContext.applicationId, sf_dir, parts, str(options))
    if key not in _made:
        _made[key] = new_events(spark, sf_dir, parts, **options)
    return _made[key]


# projection, filters


@query(f"SELECT {SHOWN}, props, day FROM {DAYS}")
def scan_all(spark, sf_dir):
    return shared_events(spark, sf_dir).read()


@query("SELECT event_id, value FROM events")
def scan_project(spark, sf_dir):
    return shared_events(spark, sf_dir).query().select("event_id", "value").df()


@query(f"SELECT {SHOWN} FROM events WHERE false")
def scan_empty(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(event_type="no such type").select(*COLUMNS).df()


def _filters() -> None:
    """A query for each filter; nullable ones over a table whose event_type is null instead of view."""
    f = field
    cases = {
        "eq": (f("user_id") == 42, "user_id = 42"),
        "ne": (f("event_type") != "click", "event_type <> 'click'"),
        "lt": (f("ts") < T0, "ts < TIMESTAMP '2024-01-10'"),
        "lte": (f("value") <= 10.5, "value <= 10.5"),
        "gt": (f("ts") > T1, "ts > TIMESTAMP '2024-01-12 06:30:00'"),
        "gte": (f("day") >= dt.date(2024, 1, 20), "CAST(ts AS DATE) >= DATE '2024-01-20'"),
        "in": (f("user_id").one_of(3, 5, 8, None), "user_id IN (3, 5, 8)"),
        "in_empty": (f("user_id").one_of(), "false"),
        "is_nil": (f("event_type").is_nil(), "event_type IS NULL"),
        "eq_nil": (f("event_type") == None, "event_type IS NULL"),  # noqa: E711
        "ne_nil": (f("event_type") != None, "event_type IS NOT NULL"),  # noqa: E711
        "ne_null": (f("event_type") != "click", "event_type <> 'click'"),
        "not_null": (~(f("event_type") == "click"), "NOT event_type = 'click'"),
        "and_or": ((f("event_type") == "click") & (f("value") > 50.0) | (f("user_id") == 7), "event_type = 'click' AND value > 50 OR user_id = 7"),
        "not": (~((f("event_type") == "click") | (f("value") < 25.0)), "NOT (event_type = 'click' OR value < 25)"),
        "starts": (f("event_type").starts_with("p"), "starts_with(event_type, 'p')"),
        "ends": (f("event_type").ends_with("k"), "ends_with(event_type, 'k')"),
        "contains": (f("event_type").contains("ig"), "contains(event_type, 'ig')"),
        "contains_percent": (f("props").contains("%"), "contains(props, '%')"),
        "starts_underscore": (f("event_type").starts_with("_"), "starts_with(event_type, '_')"),
        "true": (parse(True), "true"),
        "list": (parse([f("user_id") > 100, {"event_type": "error"}]), "user_id > 100 AND event_type = 'error'"),
        "raw": (parse("value * 2 > user_id"), "value * 2 > user_id"),
    }
    for name, (expr, where) in cases.items():
        nullable = name in ("is_nil", "eq_nil", "ne_nil", "ne_null", "not_null")

        def run(spark, sf_dir, expr=expr, nullable=nullable):
            table = _nullable(spark, sf_dir) if nullable else shared_events(spark, sf_dir)
            return table.query().filter(expr).select(*COLUMNS).df()

        base = "(SELECT event_id, ts, user_id, nullif(event_type, 'view') AS event_type, value FROM events)" if nullable else "events"
        QUERIES[f"filter_{name}"] = run
        ORACLE[f"filter_{name}"] = f"SELECT {SHOWN} FROM {base} AS e WHERE {where}"


def _nullable(spark: SparkSession, sf_dir: str) -> Table:
    key = (spark.sparkContext.applicationId, sf_dir, "nullable")
    if key not in _made:
        table = Table(spark, root(spark), spec())
        table.append(events(spark, sf_dir).withColumn("event_type", F.expr("nullif(event_type, 'view')")))
        _made[key] = table
    return _made[key]


_filters()


_NUMBERS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("tenth", T.FloatType()), T.StructField("cents", T.DecimalType(10, 2)), T.StructField("third", T.IntegerType())])
_NUMBERS_SQL = "(SELECT event_id, CAST(event_id % 10 AS FLOAT) / CAST(10 AS FLOAT) AS tenth, CAST(event_id % 500 AS DECIMAL(10, 2)) / 100 AS cents, event_id % 3 AS third FROM events)"


def _numbers(spark: SparkSession, sf_dir: str) -> Table:
    """Events as numbers of other types, in files that hold one value of each or few, so that skipping matters."""
    table = Table(spark, root(spark), TableSpec("numbers", _NUMBERS, partition_by=("tenth",), sort_within_files=("cents",), stats_columns=("tenth", "cents", "third")))
    tenth = (F.col("event_id") % 10).cast("float") / F.lit(10).cast("float")
    table.append(source(spark, sf_dir, "events").select("event_id", tenth.cast("float").alias("tenth"), ((F.col("event_id") % 500) / F.lit(100)).alias("cents"), (F.col("event_id") % 3).cast("int").alias("third")))
    return table


@query(f"SELECT event_id FROM {_NUMBERS_SQL} WHERE event_id % 10 = 1")
def filter_float_eq(spark, sf_dir):
    return _numbers(spark, sf_dir).query().filter(field("tenth") == 0.1).select("event_id").df()


@query(f"SELECT event_id FROM {_NUMBERS_SQL} WHERE event_id % 10 <= 7")
def filter_float_lte(spark, sf_dir):
    return _numbers(spark, sf_dir).query().filter(field("tenth") <= 0.7).select("event_id").df()


@query(f"SELECT event_id FROM {_NUMBERS_SQL} WHERE cents = CAST(1.005 AS DECIMAL(10, 2)) OR cents >= 4.99")
def filter_decimal_scale(spark, sf_dir):
    return _numbers(spark, sf_dir).query().filter((field("cents") == decimal.Decimal("1.005")) | (field("cents") >= decimal.Decimal("4.994"))).select("event_id").df()


@query(f"SELECT event_id FROM {_NUMBERS_SQL} WHERE event_id % 10 <> 1 AND event_id % 10 <> 3")
def delete_float(spark, sf_dir):
    table = _numbers(spark, sf_dir)
    table.delete_where(field("tenth") == 0.1)
    table.delete_where(field("tenth").one_of(0.3))
    return table.query().select("event_id").df()


@query(f"SELECT {SHOWN} FROM events WHERE false")
def filter_false(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(False).select(*COLUMNS).df()


@query(f"SELECT {SHOWN} FROM events WHERE event_type = 'click' AND value > 20 AND user_id < 100")
def filter_accumulated(spark, sf_dir):
    q = shared_events(spark, sf_dir).query().filter(event_type="click").filter(field("value") > 20.0)
    return q.filter(field("user_id") < 100).select(*COLUMNS).df()


# order, limit, pages


def _sorts() -> None:
    nulls = {"asc": "ASC NULLS LAST", "desc": "DESC NULLS LAST", "asc_nils_first": "ASC NULLS FIRST", "asc_nils_last": "ASC NULLS LAST", "desc_nils_first": "DESC NULLS FIRST", "desc_nils_last": "DESC NULLS LAST"}
    for direction, sql in nulls.items():

        def run(spark, sf_dir, direction=direction):
            return _nullable(spark, sf_dir).query().sort(("event_type", direction), "event_id").select("event_id", "event_type").df()

        QUERIES[f"sort_{direction}"] = run
        ORACLE[f"sort_{direction}"] = f"SELECT event_id, nullif(event_type, 'view') AS event_type FROM events ORDER BY 2 {sql}, event_id"


_sorts()


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 250")
def limit_offset(spark, sf_dir):
    return shared_events(spark, sf_dir).query().sort("ts", "event_id").offset(250).limit(100).select("event_id", "ts").df()


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def topk_value(spark, sf_dir):
    return shared_events(spark, sf_dir).query().sort(("value", "desc"), "event_id").limit(10).select("event_id", "value").df()


@query("SELECT event_id, user_id FROM events WHERE user_id > 70 OR user_id = 70 AND event_id > 5000 ORDER BY user_id, event_id LIMIT 50")
def keyset_page(spark, sf_dir):
    return shared_events(spark, sf_dir).query().sort("user_id", "event_id").after(70, 5000).limit(50).select("event_id", "user_id").df()


# aggregates

_AGGS = "count(*) AS n, count(event_type) AS typed, CAST(sum(user_id) AS BIGINT) AS total, avg(user_id) AS mean, min(value) AS low, max(value) AS high, min(ts) AS first"


def _aggregate(q):
    return q.aggregate(n="count", typed=("count", "event_type"), total=("sum", "user_id"), mean=("avg", "user_id"), low=("min", "value"), high=("max", "value"), first=("min", "ts"))


@query(f"SELECT {_AGGS} FROM events")
def agg_global(spark, sf_dir):
    return _aggregate(shared_events(spark, sf_dir).query())


@query(f"SELECT {_AGGS} FROM events WHERE event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-10'")
def agg_filtered(spark, sf_dir):
    return _aggregate(shared_events(spark, sf_dir).query().filter(field("event_type").one_of("click", "error"), field("ts") >= T0))


@query(f"SELECT {_AGGS} FROM events WHERE false")
def agg_empty(spark, sf_dir):
    return _aggregate(shared_events(spark, sf_dir).query().filter(event_type="none"))


@query("SELECT count(*) AS n FROM events")
def agg_count_from_log(spark, sf_dir):
    return shared_events(spark, sf_dir).query().aggregate(n="count")


@query("SELECT event_id % 3 = 0 AS early, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def agg_time_travel(spark, sf_dir):
    found = shared_events(spark, sf_dir, 3).query().at(version=1).aggregate(n="count")
    return found.select(F.lit(True).alias("early"), "n")


# skipping


@query(f"SELECT {SHOWN} FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) = DATE '2024-01-15'")
def prune_partition_eq(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(event_type="signup", day=dt.date(2024, 1, 15)).select(*COLUMNS).df()


@query(f"SELECT {SHOWN} FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'")
def prune_partition_range(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(field("day") >= dt.date(2024, 1, 10), field("day") <= dt.date(2024, 1, 15), event_type="signup").select(*COLUMNS).df()


@query(f"SELECT {SHOWN} FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 06:30:00'")
def prune_stats(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(field("ts") >= T0, field("ts") <= T1).select(*COLUMNS).df()


# versions


@query("SELECT event_id, value FROM events WHERE event_id % 3 < 2")
def time_travel_version(spark, sf_dir):
    return shared_events(spark, sf_dir, 3).query().at(version=2).select("event_id", "value").df()


@query("SELECT event_id, value FROM events WHERE event_id % 3 < 1")
def time_travel_as_of(spark, sf_dir):
    table = shared_events(spark, sf_dir, 3)
    return table.query().at(as_of=table.log.committed_at(1)).select("event_id", "value").df()


@query("SELECT event_id, value FROM events WHERE false")
def time_travel_v0(spark, sf_dir):
    return shared_events(spark, sf_dir, 3).query().at(version=0).select("event_id", "value").df()


@query("SELECT 3 - (event_id % 3) AS version, 'append' AS operation, CAST(count(*) AS BIGINT) AS n FROM (SELECT 2 - event_id % 3 AS event_id FROM events) GROUP BY 1")
def history_ops(spark, sf_dir):
    found = shared_events(spark, sf_dir, 3).history()
    return found.select("version", "operation", F.get_json_object("params", "$.row_count").cast("long").alias("n"))


@query(f"SELECT count(*) AS n, count(DISTINCT (event_type, day)) AS files FROM {DAYS}")
def snapshot_totals(spark, sf_dir):
    totals = shared_events(spark, sf_dir).totals()
    return spark.createDataFrame([(totals["rows"], totals["files"])], "n bigint, files bigint")


@query("SELECT event_type, min(day) AS first_day, count(*) AS n FROM " + DAYS + " GROUP BY event_type")
def snapshot_partitions(spark, sf_dir):
    rows = [(*f.values(spec(), ("event_type", "day")), f.rows) for f in shared_events(spark, sf_dir).snapshot()]
    files = spark.createDataFrame(rows, "event_type string, day date, n bigint")
    return files.groupBy("event_type").agg(F.min("day").alias("first_day"), F.sum("n").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'insert' ELSE 'delete' END AS _change FROM events WHERE event_id % 3 = 2 OR event_type = 'error'")
def change_feed(spark, sf_dir):
    table = new_events(spark, sf_dir, 3)
    table.delete_where(field("event_type") == "error")
    table.append(events(spark, sf_dir).where("event_type = 'error' AND event_id % 3 = 2"))
    return table.changes(2).select("event_id", "_change")


# changes


@query(f"SELECT {SHOWN} FROM events WHERE NOT (user_id < 50 AND value > 30)")
def delete_where(spark, sf_dir):
    table = new_events(spark, sf_dir)
    table.delete_where((field("user_id") < 50) & (field("value") > 30.0))
    return table.query().select(*COLUMNS).df()


@query("SELECT event_id, ts, user_id, nullif(event_type, 'view') AS event_type, value FROM events WHERE coalesce(NOT nullif(event_type, 'view') = 'click', true)")
def delete_null_pred(spark, sf_dir):
    table = Table(spark, root(spark), spec(partition_by=("day",)))
    table.append(events(spark, sf_dir).withColumn("event_type", F.expr("nullif(event_type, 'view')")))
    table.delete_where(field("event_type") == "click")
    return table.query().select(*COLUMNS).df()


@query(f"SELECT {SHOWN} FROM events WHERE event_type <> 'purchase'")
def delete_partitions(spark, sf_dir):
    table = new_events(spark, sf_dir)
    table.delete_where(event_type="purchase")
    return table.query().select(*COLUMNS).df()


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE NOT l_quantity > 25")
def delete_dup_pk(spark, sf_dir):
    df = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    table = Table(spark, root(spark), TableSpec("lineitem", df.schema, primary_key=("l_orderkey", "l_linenumber"), partition_by=("l_returnflag",), stats_columns=("l_quantity",)))
    table.append(df)
    table.delete_where(field("l_quantity") > 25.0)
    return table.read()


@query("SELECT event_id, value FROM events WHERE event_id <> 17")
def delete_row(spark, sf_dir):
    table = new_events(spark, sf_dir, primary_key=("event_id",), stats_columns=("event_id",))
    table.delete_row(event_id=17)
    table.delete_row(event_id=-1)
    return table.query().select("event_id", "value").df()


@query("SELECT event_id, CASE WHEN user_id = 9 THEN 0.5 ELSE value END AS value, CASE WHEN user_id = 9 THEN NULL ELSE props END AS props FROM events")
def update_where(spark, sf_dir):
    table = new_events(spark, sf_dir)
    table.update_where(field("user_id") == 9, value=0.5, props=None)
    return table.query().select("event_id", "value", "props").df()


@query("SELECT event_type, count(*) AS n FROM (SELECT CASE WHEN value > 100 AND event_type = 'click' THEN 'hot' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def update_partition_move(spark, sf_dir):
    table = new_events(spark, sf_dir)
    table.update_where((field("value") > 100.0) & (field("event_type") == "click"), event_type="hot")
    counts = spark.createDataFrame([(f.values(spec(), ("event_type",))[0], f.rows) for f in table.snapshot()], "event_type string, n bigint")
    return counts.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT event_id, CASE WHEN event_id = 23 THEN 1.25 ELSE value END AS value FROM events")
def update_row(spark, sf_dir):
    table = new_events(spark, sf_dir, primary_key=("event_id",), stats_columns=("event_id",))
    table.update_row({"event_id": 23}, value=1.25)
    return table.query().select("event_id", "value").df()


# upkeep


@query(f"SELECT {SHOWN} FROM events")
def optimize_content(spark, sf_dir):
    table = new_events(spark, sf_dir, 4, partition_by=("event_type",))
    table.optimize()
    return table.query().select(*COLUMNS).df()


@query("SELECT 5 AS partitions_compacted, 20 AS files_removed, 5 AS files_added")
def optimize_counters(spark, sf_dir):
    done = new_events(spark, sf_dir, 4, partition_by=("event_type",)).optimize()
    names = ("partitions_compacted", "files_removed", "files_added")
    return spark.createDataFrame([tuple(done[k] for k in names)], ", ".join(f"{n} int" for n in names))


@query(f"SELECT {SHOWN} FROM events WHERE event_type <> 'error'")
def vacuum_content(spark, sf_dir):
    table = new_events(spark, sf_dir, 2, partition_by=("event_type",))
    table.delete_where(event_type="error")
    table.optimize(2)
    table.vacuum(retention_hours=0)
    return table.query().select(*COLUMNS).df()


@query(f"SELECT {SHOWN} FROM events")
def auto_compact_content(spark, sf_dir):
    return new_events(spark, sf_dir, 4, partition_by=("event_type",), auto_compact_threshold=3).query().select(*COLUMNS).df()


@query("SELECT 1 AS partitions_compacted, 4 AS files_removed, 1 AS files_added, CAST(count(DISTINCT event_type) AS INT) * 4 - 3 AS files FROM events")
def optimize_partition(spark, sf_dir):
    table = new_events(spark, sf_dir, 4, partition_by=("event_type",))
    done = table.optimize(partition={"event_type": "click"})
    return spark.createDataFrame([(done["partitions_compacted"], done["files_removed"], done["files_added"], table.totals()["files"])], "partitions_compacted int, files_removed int, files_added int, files int")


@query("SELECT 'dry run' AS what, CAST(2 + 2 * count(DISTINCT event_type) AS INT) - 2 AS n FROM events UNION ALL SELECT 'deleted', CAST(2 * count(DISTINCT event_type) AS INT) FROM events UNION ALL SELECT 'again', 0 UNION ALL SELECT 'kept by retention', 0")
def vacuum_counts(spark, sf_dir):
    table = new_events(spark, sf_dir, 2, partition_by=("event_type",))
    table.optimize(2)
    kept = table.vacuum()["deleted"]
    dry = len(table.vacuum(0, dry_run=True)["candidates"])
    rows = [("dry run", dry), ("deleted", table.vacuum(0)["deleted"]), ("again", table.vacuum(0)["deleted"]), ("kept by retention", kept)]
    return spark.createDataFrame(rows, "what string, n int")


@query("SELECT CAST(count(DISTINCT event_type) AS INT) AS compacted, 0 AS errors, CAST(count(*) AS BIGINT) AS n FROM events")
def auto_compact_async(spark, sf_dir):
    table = new_events(spark, sf_dir, 4, partition_by=("event_type",), auto_compact_threshold=4, auto_compact_async=True)
    table.wait_for_compaction()
    totals = table.totals()
    return spark.createDataFrame([(totals["files"], len(table.compaction_errors), totals["rows"])], "compacted int, errors int, n bigint")


@query("SELECT * FROM (VALUES ('a removed file can''t be removed again', 'ConcurrentModification'), ('a view can''t be written', 'ViewIsReadOnly'), ('no such aggregate', 'UnsupportedExpression'), ('no such column', 'UnsupportedExpression'), ('of another type', 'UnsupportedExpression'), ('out of range', 'UnsupportedExpression'), ('vacuumed', 'VersionExpired')) AS t(what, error)")
def refusals(spark, sf_dir):
    """What is refused, and by which error."""
    table = new_events(spark, sf_dir, 1, partition_by=("event_type",))
    removed = table.snapshot()[0].path
    table.log.commit("delete", {}, [], [removed])
    view = _day_view(table, refresh="recompute")

    def expired():
        table.vacuum(0)
        table.read(version=1)

    cases = {
        "a removed file can't be removed again": (ConcurrentModification, lambda: table.log.commit("delete", {}, [], [removed])),
        "a view can't be written": (ViewIsReadOnly, lambda: view.delete_where(True)),
        "no such aggregate": (UnsupportedExpression, lambda: table.query().aggregate(x=("median", "value"))),
        "no such column": (UnsupportedExpression, lambda: table.query().filter(nope=1).df()),
        "of another type": (UnsupportedExpression, lambda: table.query().filter(user_id="1").df()),
        "out of range": (UnsupportedExpression, lambda: table.query().filter(user_id=1 << 63).df()),
        "vacuumed": (VersionExpired, expired),
    }
    rows = []
    for what, (kind, run) in cases.items():
        try:
            run()
        except LoamError as error:
            rows.append((what, type(error).__name__ if isinstance(error, kind) else f"unlike {kind.__name__}: {error!r}"))
    return spark.createDataFrame(rows, "what string, error string")


@query("SELECT option, value FROM (VALUES ('name', 'events'), ('partition_by', 'event_type,day'), ('stats_columns', 'ts,user_id,value'), ('skippable_columns', 'event_type,day,ts,user_id,value'), ('sort_within_files', 'ts'), ('vacuum_retention_hours', '168')) AS t(option, value)")
def table_info(spark, sf_dir):
    wanted = ("name", "partition_by", "stats_columns", "skippable_columns", "sort_within_files", "vacuum_retention_hours")
    return shared_events(spark, sf_dir).info().where(F.col("option").isin(*wanted))


@query("SELECT CAST(count(DISTINCT event_type) AS INT) AS before, CAST(count(DISTINCT event_type) FILTER (WHERE value > 480) AS INT) AS after, CAST(count(*) FILTER (WHERE value > 480) AS BIGINT) AS n FROM events")
def backfill_statistics(spark, sf_dir):
    """Files to read before and after statistics of a column are gathered that was not declared when they were written."""
    old = new_events(spark, sf_dir, partition_by=("event_type",), stats_columns=())
    table = Table(spark, old.store.root, spec(partition_by=("event_type",), stats_columns=("value",)))
    q = table.query().filter(field("value") > 480.0)
    before = len(q.files())
    table.backfill_statistics()
    return spark.createDataFrame([(before, len(q.files()), q.count())], "before int, after int, n bigint")


@query(f"SELECT {SHOWN} FROM events UNION ALL SELECT -1, TIMESTAMP '2024-02-01 00:00:00', 1, 'made', 0.5")
def create_row(spark, sf_dir):
    table = new_events(spark, sf_dir, partition_by=("event_type",))
    table.create(event_id=-1, ts=dt.datetime(2024, 2, 1), user_id=1, event_type="made", value=0.5, day=dt.date(2024, 2, 1))
    return table.query().select(*COLUMNS).df()


@query("SELECT count(DISTINCT event_type) AS files, true AS in_order FROM events")
def in_file_order(spark, sf_dir):
    """Whether the rows of each file follow one another in the order declared."""
    table = new_events(spark, sf_dir, partition_by=("event_type",))
    rows = table.read_files(table.snapshot(), "path").select("path", "ts", F.monotonically_increasing_id().alias("place"))
    ordered = rows.withColumn("before", F.lag("ts").over(Window.partitionBy("path").orderBy("place")))
    each = ordered.groupBy("path").agg(F.coalesce(F.bool_and(F.col("before") <= F.col("ts")), F.lit(True)).alias("fine"))
    return each.agg(F.count("*").alias("files"), F.bool_and("fine").alias("in_order"))


@query("SELECT event_id FROM events WHERE user_id < 20")
def stream_rows(spark, sf_dir):
    rows = shared_events(spark, sf_dir).query().filter(field("user_id") < 20).sort("event_id").select("event_id").stream()
    return spark.createDataFrame(((r["event_id"],) for r in rows), "event_id bigint")


# ingest


@query(f"SELECT {SHOWN} FROM events")
def buffered_append(spark, sf_dir):
    table = Table(spark, root(spark), spec(write_buffer_ms=300))
    df = events(spark, sf_dir)
    callers = [threading.Thread(target=lambda k=k: table.append(df.where(F.col("event_id") % 3 == k))) for k in range(3)]
    for c in callers:
        c.start()
    for c in callers:
        c.join()
    return table.query().select(*COLUMNS).df()


def _imported(spark: SparkSession, sf_dir: str, inside: bool) -> DataFrame:
    table = Table(spark, root(spark), spec(partition_by=("event_type", "day")))
    df = events(spark, sf_dir)
    if inside:
        df.write.parquet(table.store.url("lake"))
        table = Table(spark, table.store.root, spec("plain", partition_by=()))
    else:
        df.write.partitionBy("event_type", "day").parquet(table.store.url("lake"))
    table.import_existing("lake")
    return table.query().filter(field("event_type") == "signup").select(*COLUMNS, "day").df()


@query(f"SELECT {SHOWN}, day FROM {DAYS} WHERE event_type = 'signup'")
def import_infile(spark, sf_dir):
    return _imported(spark, sf_dir, True)


@query(f"SELECT {SHOWN}, day FROM {DAYS} WHERE event_type = 'signup'")
def import_pathonly(spark, sf_dir):
    return _imported(spark, sf_dir, False)


def _import_mixed(spark: SparkSession, sf_dir: str) -> Table:
    """Files whose rows belong to several partitions, refused as they are, and rewritten."""
    table = Table(spark, root(spark), spec(partition_by=("event_type",)))
    events(spark, sf_dir).repartition(3).write.parquet(table.store.url("lake"))
    with contextlib.suppress(LoamError):
        table.import_existing("lake")
        raise AssertionError("files of mixed partitions were taken as they are")
    table.import_existing("lake", rewrite_mixed=True)
    return table


@query(f"SELECT {SHOWN} FROM events WHERE event_type = 'signup'")
def import_mixed(spark, sf_dir):
    return _import_mixed(spark, sf_dir).query().filter(event_type="signup").select(*COLUMNS).df()


@query(f"SELECT {SHOWN} FROM events WHERE event_type <> 'signup'")
def import_mixed_delete(spark, sf_dir):
    table = _import_mixed(spark, sf_dir)
    table.delete_where(event_type="signup")
    return table.query().select(*COLUMNS).df()


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'n' || event_id END AS note FROM events")
def schema_evolution(spark, sf_dir):
    first = new_events(spark, sf_dir, partition_by=("day",))
    first.delete_where(parse("event_id % 2 = 1"))
    wider = Table(spark, first.store.root, spec(schema=T.StructType([*EVENTS, T.StructField("note", T.StringType())]), partition_by=("day",)))
    wider.append(events(spark, sf_dir).where("event_id % 2 = 1").withColumn("note", F.expr("concat('n', event_id)")))
    return wider.query().select("event_id", "note").df()


@query("SELECT vec_id, embedding, label FROM embeddings")
def nested_roundtrip(spark, sf_dir):
    df = source(spark, sf_dir, "embeddings")
    table = Table(spark, root(spark), TableSpec("embeddings", df.schema, partition_by=("label",), sort_within_files=("vec_id",), stats_columns=("vec_id",)))
    table.append(df)
    return table.read()


@query(f"SELECT {SHOWN} FROM events")
def stream_append(spark, sf_dir):
    table = Table(spark, root(spark), spec(partition_by=("day",)))
    folder = table.store.url("incoming")
    source(spark, sf_dir, "events").repartition(3).write.parquet(folder)
    plain = T.StructType([f for f in EVENTS if f.name != "day"])
    stream = spark.readStream.schema(plain).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("day", F.to_date("ts"))
    for _ in range(2):  # started again, it adds nothing
        append_stream(stream, table, "ingest", table.store.url("checkpoint")).awaitTermination()
    return table.query().select(*COLUMNS).df()


def _streamed(spark: SparkSession, sf_dir: str, counted: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a counting stream over the events has put into a table when its input is used up."""
    top = root(spark)
    source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(f"{top}/incoming")
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet(f"{top}/incoming")
    out = counted(stream)
    if mode == "append":  # windows that the watermark has passed
        out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{top}/out")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{top}/out")  # noqa: E731 - the whole result, each time
    out.writeStream.foreachBatch(write).option("checkpointLocation", f"{top}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


def _in_utc(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return _in_utc(_streamed(spark, sf_dir, lambda s: windowed_counts(s, "ts", ["event_type"], "1 day", "60 days"), "complete"))


@query("""
SELECT start, start + INTERVAL '2 days' AS "end", event_type, count(*) AS n
FROM (SELECT event_type, unnest([CAST(ts AS DATE) - 1, CAST(ts AS DATE)])::TIMESTAMP AS start FROM events) GROUP BY ALL
""")
def stream_sliding(spark, sf_dir):
    counted = _streamed(spark, sf_dir, lambda s: windowed_counts(s, "ts", ["event_type"], "2 days", "60 days", "1 day"), "complete")
    return _in_utc(counted)


@query("""
WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM m)
SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, nth
""")
def stream_sessions(spark, sf_dir):
    return _in_utc(_streamed(spark, sf_dir, lambda s: session_counts(s, "ts", ["user_id"], "6 hours", "60 days"), "complete"))


# views

_BY_DAY = "SELECT event_type, day, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM source GROUP BY event_type, day"
_BY_TYPE = _BY_DAY.replace("event_type, day, ", "event_type, ").replace("GROUP BY event_type, day", "GROUP BY event_type")
_DAY_SCHEMA = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("day", T.DateType()), T.StructField("n", T.LongType()), T.StructField("high", T.LongType()), T.StructField("total", T.DoubleType())])
_TYPE_SCHEMA = T.StructType([f for f in _DAY_SCHEMA if f.name != "day"])


def _oracle_view(sql: str, where: str = "true") -> str:
    return sql.replace("FROM source", f"FROM (SELECT * FROM {DAYS} WHERE {where}) AS source").replace("count(*) AS n", "CAST(count(*) AS BIGINT) AS n")


def _day_view(table: Table, name: str = "by_day", **options: object) -> View:
    options = {"partition_by": ("event_type", "day"), "refresh": "partition_incremental"} | options
    return View(table.spark, table.store.root, ViewSpec(name, _DAY_SCHEMA, sources={"source": table}, query=_BY_DAY, **options))


@query(_oracle_view(_BY_DAY))
def view_recompute(spark, sf_dir):
    view = _day_view(shared_events(spark, sf_dir), f"v{uuid.uuid4().hex}", refresh="recompute")
    view.refresh()
    return view.read()


@query(_oracle_view(_BY_DAY))
def view_incremental(spark, sf_dir):
    table = Table(spark, root(spark), spec())
    view = _day_view(table)
    df = events(spark, sf_dir)
    for k in range(2):
        table.append(df.where(F.col("event_id") % 2 == k))
        view.refresh()
    return view.read()


@query(_oracle_view(_BY_TYPE))
def view_incremental_subset(spark, sf_dir):
    table = Table(spark, root(spark), spec())
    view = View(spark, table.store.root, ViewSpec("by_type", _TYPE_SCHEMA, partition_by=("event_type",), sources={"source": table}, query=_BY_TYPE, refresh="partition_incremental"))
    df = events(spark, sf_dir)
    for where in ("day < '2024-01-15'", "day >= '2024-01-15' AND event_type <> 'view'", "day >= '2024-01-15' AND event_type = 'view'"):
        table.append(df.where(where))
        view.refresh()
    return view.read()


@query(_oracle_view(_BY_DAY, "NOT (user_id < 40 AND event_type = 'click')"))
def view_after_delete(spark, sf_dir):
    table = new_events(spark, sf_dir)
    view = _day_view(table)
    view.refresh()
    table.delete_where((field("user_id") < 40) & (field("event_type") == "click"))
    view.refresh()
    return view.read()


@query("SELECT event_type, max(n) AS most FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def view_on_view(spark, sf_dir):
    table = new_events(spark, sf_dir)
    days = _day_view(table)
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("most", T.LongType())])
    top = View(spark, table.store.root, ViewSpec("top", schema, sources={"d": days}, query="SELECT event_type, max(n) AS most FROM d GROUP BY event_type"))
    refresh_all([top, days])
    return top.read()


@query(_oracle_view(_BY_DAY, "event_id % 2 = 0"))
def view_time_travel(spark, sf_dir):
    table = Table(spark, root(spark), spec())
    view = _day_view(table)
    for k in range(2):
        table.append(events(spark, sf_dir).where(F.col("event_id") % 2 == k))
        view.refresh()
    return view.read(version=1)


def _sql_view(spark: SparkSession, sf_dir: str, sql: str, schema: str, *names: str) -> DataFrame:
    """A recomputed view over tables of the plain inputs."""
    top = root(spark)
    sources = {}
    for name in names:
        df = source(spark, sf_dir, name)
        sources[name] = Table(spark, top, TableSpec(name, df.schema))
        sources[name].append(df)
    view = View(spark, top, ViewSpec("result", T.StructType.fromDDL(schema), sources=sources, query=sql))
    view.refresh()
    return view.read()


def _sql_views() -> None:
    exact = "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)"
    cases = {
        "join": (f"SELECT n_name, c_mktsegment, count(*) AS n, {exact} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment", "n_name string, c_mktsegment string, n bigint, total double", ("orders", "customer", "nation")),
        "left_join": ("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", "c_custkey bigint, n bigint", ("customer", "orders")),
        "window": ("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS nth, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS three FROM events", "event_id bigint, nth bigint, before string, three double", ("events",)),
        "rollup": (f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {exact} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "o_orderstatus string, o_orderpriority string, n bigint, total double", ("orders",)),
        "cube": ("SELECT event_type, user_id % 3 AS third, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)", "event_type string, third bigint, n bigint", ("events",)),
        "grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "l_returnflag string, l_linestatus string, n bigint", ("lineitem",)),
        "distinct": ("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type", "event_type string, users bigint", ("events",)),
        "setops": ("(SELECT user_id FROM events WHERE event_type = 'click' AND value > 100 EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 120) UNION ALL (SELECT user_id FROM events WHERE value > 300 INTERSECT SELECT user_id FROM events WHERE event_type = 'signup' AND value < 5)", "user_id bigint", ("events",)),
        "semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", "c_custkey bigint", ("customer", "orders")),
        "anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", "c_custkey bigint", ("customer", "orders")),
        "full_join": ("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL OUTER JOIN (SELECT * FROM orders WHERE o_custkey % 3 = 0) o ON o_custkey = c_custkey", "c_custkey bigint, o_orderkey bigint", ("customer", "orders")),
        "right_join": ("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c RIGHT JOIN orders o ON o_custkey = c_custkey", "c_custkey bigint, o_orderkey bigint", ("customer", "orders")),
        "cross_join": ("SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey", "n_name string, r_name string", ("nation", "region")),
        "using_join": ("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) n JOIN (SELECT s_nationkey AS k, s_name FROM supplier) s USING (k)", "k int, n_name string, s_name string", ("nation", "supplier")),
        "natural_join": ("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) r", "k int, n_name string, r_name string", ("nation", "region")),
        "setops_all": ("(SELECT user_id FROM events WHERE value > 150 INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'click') UNION ALL (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT ALL SELECT user_id FROM events WHERE value > 30) UNION SELECT user_id FROM events WHERE user_id < 5", "user_id bigint", ("events",)),
        "cte_case": ("WITH t AS (SELECT user_id, sum(CAST(value AS DECIMAL(18, 2))) AS total FROM events GROUP BY user_id HAVING count(*) > 2) SELECT user_id, CASE WHEN total > 1000 THEN 'high' WHEN total > 500 THEN 'middle' ELSE 'low' END AS band FROM t", "user_id bigint, band string", ("events",)),
        "range_join": ("SELECT s_suppkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey BETWEEN n_nationkey - 1 AND n_nationkey + 1 GROUP BY s_suppkey", "s_suppkey bigint, n bigint", ("supplier", "nation")),
    }
    for name, (sql, schema, tables) in cases.items():

        def run(spark, sf_dir, sql=sql, schema=schema, tables=tables):
            return _sql_view(spark, sf_dir, sql, schema, *tables)

        QUERIES[f"view_{name}"] = run
        ORACLE[f"view_{name}"] = sql


_sql_views()


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, avg(CAST(props->>'k' AS DOUBLE)) AS mean FROM events GROUP BY event_type")
def view_filter_agg_json(spark, sf_dir):
    sql = "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, avg(CAST(get_json_object(props, '$.k') AS DOUBLE)) AS mean FROM events GROUP BY event_type"
    return _sql_view(spark, sf_dir, sql, "event_type string, high bigint, mean double", "events")


_ASOF = """
SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
ON e.user_id = p.user_id AND e.ts >= p.ts
"""


@query(_ASOF)
def view_asof(spark, sf_dir):
    table = shared_events(spark, sf_dir)

    def newest(session: SparkSession) -> DataFrame:
        rows = session.table("events")
        bought = rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"))
        clicks = rows.where("event_type = 'click'").select("event_id", "user_id", "ts")
        return asof_join(clicks, bought, "ts", "bought", ["user_id"], ["purchase_id"]).select("event_id", "purchase_id")

    schema = T.StructType.fromDDL("event_id bigint, purchase_id bigint")
    view = View(spark, table.store.root, ViewSpec(f"asof{uuid.uuid4().hex}", schema, sources={"events": table}, query=newest))
    view.refresh()
    return view.read()


def _letters():
    """A vectorized UDF: whole Arrow batches at a time, with a type of its own."""

    @F.pandas_udf("bigint")
    def letters(text: pd.Series) -> pd.Series:
        return text.str.len()

    return letters


@query("SELECT event_type, count(*) AS n FROM events WHERE length(event_type) = 5 GROUP BY event_type")
def view_udf(spark, sf_dir):
    table = shared_events(spark, sf_dir)
    schema = T.StructType.fromDDL("event_type string, n bigint")
    sql = "SELECT event_type, count(*) AS n FROM events WHERE letters(event_type) = 5 AND first_letter(event_type) = substring(event_type, 1, 1) GROUP BY event_type"
    view = View(spark, table.store.root, ViewSpec(f"udf{uuid.uuid4().hex}", schema, sources={"events": table}, query=sql, functions={"letters": _letters(), "first_letter": lambda text: text[:1]}))
    view.refresh()
    return view.read()


_FUNCTIONS = """
SELECT event_id, round(value / 7, 3) AS rounded, event_id % 7 * 3 AS times, concat(event_type, '-', CAST(user_id AS STRING)) AS joined,
  {list} AS picked, to_timestamp('2024-01-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') || ' 10:20:30'{format}) + INTERVAL {hours} AS later,
  abs(value - 100) AS away, upper(substring(event_type, 1, 3)) AS head, coalesce(nullif(event_type, 'view'), 'none') AS typed,
  {hash} AS steady
FROM events
"""


@query(_FUNCTIONS.format(list="['a', 'b', 'c'][event_id % 3 + 1]", format="", hours="'5 hours'", hash="true").replace("to_timestamp(", "(CAST(").replace("10:20:30')", "10:20:30' AS TIMESTAMP))").replace("AS STRING", "AS VARCHAR"))
def view_functions(spark, sf_dir):
    sql = _FUNCTIONS.format(list="array('a', 'b', 'c')[CAST(event_id % 3 AS INT)]", format="", hours="5 HOURS", hash="xxhash64(event_id) = xxhash64(event_id) AND rand() < 1").replace("to_timestamp(", "to_timestamp_ntz(")
    return _sql_view(spark, sf_dir, sql, "event_id bigint, rounded double, times bigint, joined string, picked string, later timestamp_ntz, away double, head string, typed string, steady boolean", "events")


@query("SELECT CAST(x AS BIGINT) AS x, CAST(count(event_id) AS BIGINT) AS n FROM range(0, 40) AS r(x) LEFT JOIN events ON user_id = x GROUP BY x")
def view_range(spark, sf_dir):
    return _sql_view(spark, sf_dir, "SELECT id AS x, count(event_id) AS n FROM range(0, 40) LEFT JOIN events ON user_id = id GROUP BY id", "x bigint, n bigint", "events")


@query("SELECT event_type, true AS close FROM events GROUP BY event_type")
def view_approx_distinct(spark, sf_dir):
    # a sketch beside count(DISTINCT) would be held once for each pair of type and user; repeats don't change a sketch
    pairs = "(SELECT DISTINCT event_type, user_id FROM events)"
    sql = f"SELECT event_type, abs(approx_count_distinct(user_id, 0.02) - count(user_id)) <= 0.1 * count(user_id) AS close FROM {pairs} GROUP BY event_type"
    return _sql_view(spark, sf_dir, sql, "event_type string, close boolean", "events")


@query("SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS nth FROM events")
def view_window_incremental(spark, sf_dir):
    table = Table(spark, root(spark), spec(partition_by=("event_type",)))
    schema = T.StructType.fromDDL("event_type string, event_id bigint, nth bigint")
    sql = "SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS nth FROM events"
    view = View(spark, table.store.root, ViewSpec("nth", schema, partition_by=("event_type",), sources={"events": table}, query=sql, refresh="partition_incremental"))
    for k in range(2):
        table.append(events(spark, sf_dir).where(F.col("event_id") % 2 == k))
        view.refresh()
    return view.read()


@query("SELECT * FROM (VALUES (1, 'refresh_incremental', 'partition_incremental'), (2, 'refresh_watermark', 'partition_incremental'), (2, 'refresh_watermark', 'up_to_date'), (3, 'refresh_full', 'recompute')) AS t(version, operation, strategy)")
def view_refresh_outcomes(spark, sf_dir):
    """What refreshes return and record: changed partitions, a new version without changes, nothing new, an override."""
    table = new_events(spark, sf_dir)
    view = _day_view(table)
    rows = []
    for step in range(4):
        if step == 1:
            table.log.commit("note", {})
        done = view.refresh("recompute" if step == 3 else None)
        rows.append((view.version(), view.history(1).first()["operation"], done if isinstance(done, str) else done["strategy"]))
    return spark.createDataFrame(rows, "version int, operation string, strategy string")


@query("SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS partitions, CAST(count(*) AS BIGINT) AS rows_written, 0 AS files_removed FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events)".replace("count(DISTINCT event_type)", "count(*)"))
def view_summary(spark, sf_dir):
    done = _day_view(new_events(spark, sf_dir)).refresh()
    return spark.createDataFrame([(done["partitions"], done["rows_written"], done["files_removed"])], "partitions bigint, rows_written bigint, files_removed int")


# the demo application's queries, over the events


@query("SELECT event_id, value FROM events WHERE event_id = 77")
def app_get(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(event_id=77).select("event_id", "value").df()


@query("SELECT event_id, ts FROM events ORDER BY event_id LIMIT 50")
def app_events(spark, sf_dir):
    return shared_events(spark, sf_dir).query().sort("event_id").limit(50).select("event_id", "ts").df()


@query("SELECT event_id, ts FROM events WHERE user_id = 12")
def app_by_user(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(user_id=12).select("event_id", "ts").df()


@query("SELECT event_id, ts FROM events WHERE event_type = 'error'")
def app_by_type(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(event_type="error").select("event_id", "ts").df()


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 06:30:00'")
def app_in_range(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(field("ts") >= T0, field("ts") <= T1).select("event_id", "ts").df()


@query("SELECT event_id, event_type FROM events WHERE starts_with(event_type, 's')")
def app_by_prefix(spark, sf_dir):
    return shared_events(spark, sf_dir).query().filter(field("event_type").starts_with("s")).select("event_id", "event_type").df()


@query("SELECT event_id, ts FROM events WHERE user_id = 30 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id LIMIT 1000")
def app_for_station(spark, sf_dir):
    q = shared_events(spark, sf_dir).query().filter(user_id=30, event_type="click").filter(field("ts") >= dt.datetime(2024, 1, 5))
    return q.sort(("ts", "desc"), "event_id").limit(1000).select("event_id", "ts").df()


@query(f"SELECT event_id FROM {DAYS} WHERE day <> DATE '2024-01-03'")
def app_purge_day(spark, sf_dir):
    table = new_events(spark, sf_dir, partition_by=("day",))
    table.delete_where(day=dt.date(2024, 1, 3))
    return table.query().select("event_id").df()


@query("SELECT event_type, avg(CAST(props->>'k' AS DOUBLE)) AS mean, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def function_columns(spark, sf_dir):
    rows = shared_events(spark, sf_dir).read()
    return rows.groupBy("event_type").agg(F.avg(json_number("props", "k")).alias("mean"), exact_sum("value").alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks from a time on, newest first: files skipped by partition and statistics, then the top 500."""
    q = shared_events(spark, sf_dir, partition_by=("day",), stats_columns=("ts", "value")).query()
    return q.filter(field("event_type") == "click", field("ts") >= T0).sort(("ts", "desc"), "event_id").limit(500).df()
