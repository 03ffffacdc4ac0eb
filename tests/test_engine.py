"""The engine's tables, filters and views against plain Python."""

import datetime as dt
import decimal
import enum
import os
import random
import threading
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.operators.table import Table
from loam.operators.view import RefreshWorker, View, refresh_all
from loam.plans import types
from loam.plans.expr import Constant, Negated, field, parse
from loam.plans.types import ConcurrentModification, LoamError, TableSpec, UnsupportedExpression, VersionExpired, ViewIsReadOnly, ViewSpec
from loam.sources import files
from loam.sources.log import File
from loam.sources.store import HadoopStore, LocalStore
from loam.streaming.sink import append_stream, batch_writer, session_counts, windowed_counts


def struct(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LONG, TEXT, DOUBLE, DATE, TIME = T.LongType(), T.StringType(), T.DoubleType(), T.DateType(), T.TimestampNTZType()
SCHEMA = struct(id=LONG, site=TEXT, day=DATE, at=TIME, value=DOUBLE, price=T.DecimalType(10, 2), note=TEXT)
DAY = dt.date(2026, 6, 11)
NAN = float("nan")


class Kind(enum.Enum):
    FAULT = "fault"


def row(i, site="a", day=0, value=1.0, note=None, price="1.50"):
    return (i, site, DAY + dt.timedelta(day), dt.datetime(2026, 6, 11, 8, i % 60, 0, 1), value, decimal.Decimal(price), note)


def spec(name="t", **options):
    options = {"partition_by": ("site", "day"), "sort_within_files": ("at",), "stats_columns": ("at", "value", "note", "price"), "primary_key": ("id",)} | options
    return TableSpec(name, SCHEMA, **options)


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path), spec())


def add(table, *rows):
    return table.append(table.spark.createDataFrame(list(rows), SCHEMA))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


# reading and files


def test_literal_rows(spark, tmp_path):
    schema = struct(site=TEXT, day=DATE, sensor_id=TEXT, recorded_at=TIME, value=DOUBLE)
    t = Table(spark, str(tmp_path), TableSpec("sensor", schema, partition_by=("site", "day"), sort_within_files=("sensor_id", "recorded_at"), stats_columns=("recorded_at", "value")))
    rows = [("CHI", DAY, "s1", dt.datetime(2026, 6, 11, 8), 22.4), ("CHI", DAY, "s2", dt.datetime(2026, 6, 11, 9), 23.1), ("NYC", DAY, "s3", dt.datetime(2026, 6, 11, 8, 30), 19.8)]
    assert t.append(spark.createDataFrame(rows, schema)) == 1
    assert t.totals()["files"] == 2
    q = t.query()
    assert q.count() == 3
    assert q.filter(site="CHI").count() == 2
    assert q.filter(field("recorded_at") >= dt.datetime(2026, 6, 11, 8, 15)).count() == 2
    assert [r["sensor_id"] for r in q.sort("sensor_id").limit(2).df().collect()] == ["s1", "s2"]
    assert [f.path.split("/")[1:3] for f in t.snapshot()] == [["day=2026-06-11", "site=CHI"], ["day=2026-06-11", "site=NYC"]]


def test_files_skipped(table):
    add(table, *[row(100 * s + d, f"s{s}", d, value=float(d)) for s in range(4) for d in range(10)])
    q = table.query()
    assert len(q.files()) == 40
    assert len(q.filter(site="s1").files()) == 10
    assert len(q.filter(site="s1", day=DAY).files()) == 1
    assert len(q.filter(field("day") >= DAY + dt.timedelta(2), field("day") <= DAY + dt.timedelta(4)).files()) == 12
    assert len(q.filter(field("value") > 7.0).files()) == 8
    assert len(q.filter(~(field("value") <= 7.0)).files()) == 8
    assert len(q.filter((field("value") > 7.0) | (field("site") == "s0")).files()) == 16
    assert len(q.filter(field("site").starts_with("s")).files()) == 40
    assert len(q.filter(field("site").one_of("s1", "s3", "zz")).files()) == 20
    assert len(q.filter(field("note") != None).files()) == 0  # noqa: E711
    plan = q.filter(field("value") > 7.0, site="s1").select("id").df()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(value,7.0)" in plan and "price" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_awkward_partition_values(table):
    sites = ["", None, "a b", "x/y", "50%", "it's", "k=v", "ü", "a+b", "{*}", "a:b", "\\"]
    add(table, *[row(k, s) for k, s in enumerate(sites)])
    assert ids(table.read()) == list(range(len(sites)))
    for k, s in enumerate(sites):
        q = table.query().filter(field("site") == s)
        assert ids(q.df()) == [k]
        assert len(q.files()) == 1
    assert table.delete_where(field("site").is_nil())["rows_affected"] == 1
    assert ids(table.query().filter(site="").df()) == [0]


def test_nan_null_decimal_and_micros(table):
    add(table, row(1, value=NAN), row(2, value=None), row(3, value=5.0, price="9.00"), row(4, value=-1.0, price="10.00"))
    assert ids(table.query().filter(field("value") > 4.0).df()) == [1, 3]  # NaN is greatest
    assert ids(table.query().filter(field("value") == NAN).df()) == [1]
    assert ids(table.query().filter(field("price") > decimal.Decimal(9)).df()) == [4]
    assert ids(table.query().filter(field("at") == dt.datetime(2026, 6, 11, 8, 3, 0, 1)).df()) == [3]
    assert ids(table.query().filter(field("at") >= dt.datetime(2026, 6, 11, 8, 4, 0, 1, tzinfo=dt.UTC)).df()) == [4]


def test_text_is_literal(table):
    notes = ["50%", "50x", "a_b", "axb", "c\\d", "", None]
    add(table, *[row(k, note=n) for k, n in enumerate(notes)])
    q = table.query()
    assert ids(q.filter(field("note").contains("0%")).df()) == [0]
    assert ids(q.filter(field("note").starts_with("a_")).df()) == [2]
    assert ids(q.filter(field("note").ends_with("\\d")).df()) == [4]
    assert ids(q.filter(field("note").starts_with("")).df()) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("bad", [field("nope") == 1, field("id") == "1", field("day") == dt.datetime(2026, 6, 11), field("value") < None, field("value") > True, field("id").starts_with("1")])
def test_refused_filters(table, bad):
    add(table, row(1))
    with pytest.raises(UnsupportedExpression):
        table.query().filter(bad).df()


def test_other_refusals(spark, table):
    for wrong in (3, object()):
        with pytest.raises(UnsupportedExpression):
            parse(wrong)
    with pytest.raises(UnsupportedExpression):
        table.query().sort(("id", "up"))
    with pytest.raises(UnsupportedExpression):
        table.query().aggregate(x=("median", "value"))
    with pytest.raises(ValueError, match="no column"):
        table.append(spark.range(1).toDF("nope"))
    with pytest.raises(ValueError, match="names no column"):
        spec(partition_by=("nope",))
    for version in (True, "1", -1, 9):
        with pytest.raises(LoamError):
            table.read(version=version)
    with pytest.raises(LoamError):
        table.read(as_of="yesterday")


def test_enum_and_kwargs(table):
    add(table, row(1, note="fault"), row(2, note="andon"))
    assert ids(table.query().filter(note=Kind.FAULT).df()) == [1]
    assert ids(table.query().filter({"note": "andon"}, [field("id") > 0]).df()) == [2]


def test_sort_and_pages(table):
    add(table, *[row(k, value=None if k % 4 == 0 else float(k % 3)) for k in range(12)])
    for direction in ("asc", "desc", "asc_nils_first", "desc_nils_first"):
        q = table.query().sort(("value", direction), "id")
        whole = [r["id"] for r in q.df().collect()]
        assert [r["id"] for r in q.offset(3).limit(4).df().collect()] == whole[3:7]
        keys = {r["id"]: r["value"] for r in table.read().collect()}
        for k, i in enumerate(whole):
            if keys[i] is not None:
                assert [r["id"] for r in q.after(keys[i], i).df().collect()] == whole[k + 1 :], (direction, i)
                break
    assert [r["id"] for r in table.query().sort("id").stream()] == list(range(12))


def test_count_without_reading(table):
    add(table, *[row(k) for k in range(7)])
    for f in table.snapshot():
        table.store.delete(f.path)
    assert table.query().count() == 7
    assert table.totals()["rows"] == 7


# filters keep what they should: any filter, with and without skipping

columns = {
    "site": st.sampled_from(["a", "b", "", None, "ab"]),
    "value": st.sampled_from([0.0, 1.0, 2.5, NAN, None]),
    "note": st.sampled_from(["x", "xy", "y%", None]),
    "id": st.integers(0, 20),
}
leaf = st.one_of(
    *[st.tuples(st.sampled_from(["==", "!=", "<", "<=", ">", ">="]), st.just(c), v) for c, v in columns.items()],
    st.tuples(st.just("in"), st.just("value"), st.lists(columns["value"], max_size=3)),
    st.tuples(st.just("in"), st.just("site"), st.lists(columns["site"], max_size=3)),
    st.tuples(st.sampled_from(["nil"]), st.sampled_from(list(columns)), st.none()),
    st.tuples(st.sampled_from(["starts_with", "ends_with", "contains"]), st.sampled_from(["site", "note"]), st.sampled_from(["x", "y", "", "b", "%"])),
)


def build(x):
    if isinstance(x, tuple) and x[0] == "leaf":
        op, name, value = x[1]
        f = field(name)
        if op == "in":
            return f.one_of(*value)
        if op == "nil":
            return f.is_nil()
        if op in ("starts_with", "ends_with", "contains"):
            return getattr(f, op)(value)
        if value is None and op not in ("==", "!="):
            return Constant(True)
        return {"==": f.__eq__, "!=": f.__ne__, "<": f.__lt__, "<=": f.__le__, ">": f.__gt__, ">=": f.__ge__}[op](value)
    if x[0] == "not":
        return Negated(build(x[1]))
    return build(x[1]) & build(x[2]) if x[0] == "and" else build(x[1]) | build(x[2])


tree = st.recursive(
    st.tuples(st.just("leaf"), leaf),
    lambda t: st.one_of(st.tuples(st.just("not"), t), st.tuples(st.sampled_from(["and", "or"]), t, t)),
    max_leaves=4,
)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    r = random.Random(4)
    t = Table(spark, str(tmp_path_factory.mktemp("many")), spec(partition_by=("site",), stats_columns=("id", "value", "note")))
    rows = []
    for k in range(4):
        rows.append([row(r.randint(0, 20), r.choice(["a", "b", "", None, "ab"]), value=r.choice([0.0, 1.0, 2.5, NAN, None][k:]), note=r.choice(["x", "xy", "y%", None])) for _ in range(8)])
        add(t, *rows[-1])
    return t


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree)
def test_skipping_loses_nothing(many, shape):
    expr = build(shape)
    whole = many.read().where(F.coalesce(expr.column(many.spec), F.lit(False)))
    assert ids(many.query().filter(expr).df()) == ids(whole)


# numbers: a filter gives what Spark's own comparison with the value as the column holds it gives

NUMBERS = struct(id=LONG, b=T.ByteType(), s=T.ShortType(), i=T.IntegerType(), l=LONG, f=T.FloatType(), d=DOUBLE, c=T.DecimalType(10, 2), w=T.DecimalType(38, 10))
whole_numbers = st.integers(-4, 4)
fractions = st.one_of(st.sampled_from([0.1, 0.2, 0.3, -0.1, 0.7, 1.005, 1.01, 2.675, -0.0, NAN, float("inf")]), whole_numbers)
exact = st.one_of(st.decimals(-2, 2, places=3), st.sampled_from([decimal.Decimal("1.005"), decimal.Decimal("0.015"), 0.1, 1.005]), whole_numbers)
numeric = st.one_of(*[st.tuples(st.just(c), whole_numbers) for c in "bsil"], *[st.tuples(st.just(c), fractions) for c in "fd"], *[st.tuples(st.just(c), exact) for c in "cw"])


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    t = Table(spark, str(tmp_path_factory.mktemp("numbers")), TableSpec("numbers", NUMBERS, partition_by=("f",), stats_columns=tuple("bsildcw")))
    fs, ds, cs = [0.1, 0.2, 0.7, 1.005, None], [0.1, 2.675, NAN, -0.0, None], ["1.01", "1.00", "0.02", "-0.10", None]
    for k in range(5):
        c = None if cs[k] is None else decimal.Decimal(cs[k])
        t.append(spark.createDataFrame([(k, k - 2, k - 2, k - 2, k - 2, fs[k], ds[k], c, None if c is None else c + decimal.Decimal("0.005"))], NUMBERS))
    return t


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(numeric, st.sampled_from(["==", "!=", "<", "<=", ">", ">="]), st.booleans())
def test_numbers_of_all_types(numbers, leaf, op, negated):
    name, value = leaf
    kind, f = NUMBERS[name].dataType, field(name)
    expr = {"==": f.__eq__, "!=": f.__ne__, "<": f.__lt__, "<=": f.__le__, ">": f.__gt__, ">=": f.__ge__}[op](value)
    expr = ~expr if negated else expr
    column, held = F.col(name), F.lit(value).cast(kind)
    plain = {"==": column == held, "!=": column != held, "<": column < held, "<=": column <= held, ">": column > held, ">=": column >= held}[op]
    assert ids(numbers.query().filter(expr).df()) == ids(numbers.read().where(~plain if negated else plain))


def test_numbers_that_no_column_holds(numbers):
    for bad in (field("b") == 128, field("l") > 1 << 63, field("c") == decimal.Decimal(10) ** 8, field("c") == NAN, field("s").one_of(-(1 << 15) - 1)):
        with pytest.raises(UnsupportedExpression):
            numbers.query().filter(bad).df()
    assert ids(numbers.query().filter(field("f") == 0.1).df()) == [0]
    assert ids(numbers.query().filter(field("c") == decimal.Decimal("1.005")).df()) == [0]


def test_deletes_of_floats(spark, tmp_path):
    schema = struct(id=LONG, x=T.FloatType())
    t = Table(spark, str(tmp_path), TableSpec("floats", schema, stats_columns=("x",)))
    t.append(spark.createDataFrame([(1, 0.1), (2, 0.2)], schema))
    assert t.delete_where(field("x") == 0.1)["rows_affected"] == 1
    assert t.update_where(field("x") <= 0.2, x=0.3)["rows_affected"] == 1
    assert ids(t.query().filter(field("x").one_of(0.3)).df()) == [2]


# a table against a list


def test_history_of_changes_against_a_list(spark, tmp_path):
    r = random.Random(8)
    t = Table(spark, str(tmp_path), spec(partition_by=("site",), target_file_size_mb=1))
    model, versions, last = [], {0: []}, 0
    for step in range(14):
        kind = r.choice(["append", "append", "delete", "update", "optimize", "purge"])
        if kind == "append":
            new = [row(step * 10 + k, r.choice("abc"), value=float(r.randint(0, 5)), note=r.choice(["x", None])) for k in range(5)]
            add(t, *new, *new[:1])
            model = model + new + new[:1]
        elif kind == "delete":
            v = float(r.randint(0, 5))
            done = t.delete_where(field("value") == v)
            assert done["rows_affected"] == sum(x[4] == v for x in model)
            model = [x for x in model if x[4] != v]
        elif kind == "purge":
            done = t.delete_where(site="b")
            assert done["rows_affected"] == sum(x[1] == "b" for x in model)
            model = [x for x in model if x[1] != "b"]
        elif kind == "update":
            v = float(r.randint(0, 5))
            t.update_where(field("value") > v, site="c", note=None)
            model = [(*x[:1], "c", *x[2:6], None) if x[4] > v else x for x in model]
        else:
            t.optimize(2)
        last = t.version()
        versions[last] = list(model)
    for v, rows in versions.items():
        assert sorted(map(str, map(tuple, t.read(version=v).collect()))) == sorted(map(str, rows))
    assert t.read(as_of=t.log.committed_at(last)).count() == len(model)
    assert [h["version"] for h in t.history(5).collect()] == list(range(last, last - 5, -1))


def test_duplicate_keys_and_null_predicates(table):
    add(table, row(1, value=1.0), row(1, value=9.0), row(2, value=None))
    assert table.delete_where(field("value") > 5.0) == {"version": 2, "files_rewritten": 1, "rows_affected": 1}
    assert ids(table.read()) == [1, 2]
    assert table.delete_where(field("value") > 5.0) == {"version": 2, "files_rewritten": 0, "rows_affected": 0}
    assert table.update_where(field("value") == 1.0, day=DAY + dt.timedelta(3))["rows_affected"] == 1
    assert [f.values(table.spec, ("day",))[0] for f in table.snapshot()] == [DAY, DAY + dt.timedelta(3)]
    assert table.delete_row(id=2)["rows_affected"] == 1
    assert table.delete_row(id=2)["rows_affected"] == 0
    with pytest.raises(ValueError, match="primary key"):
        table.delete_row(value=3.0)


def test_whole_partitions_go_without_reading(table):
    add(table, row(1, "a"), row(2, "b"))
    for f in table.snapshot():
        if f.partition["site"] == "a":
            table.store.delete(f.path)
    assert table.delete_where(site="a")["rows_affected"] == 1
    assert ids(table.read()) == [2]


def test_empty_appends_and_creates(spark, table):
    assert table.append(spark.createDataFrame([], SCHEMA)) is None
    assert table.version() == 0
    assert table.create(id=5, site="a", day=DAY) == 1
    with pytest.raises(ValueError, match="no column"):
        table.create(nope=1)
    assert table.read(version=0).count() == 0
    assert table.query().at(version=0).aggregate(n="count", s=("sum", "id")).collect()[0].asDict() == {"n": 0, "s": None}


def test_optimize_and_vacuum(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec(partition_by=("site",)))
    for k in range(5):
        add(t, row(k, "a"), *([row(10 + k, "b")] if k < 2 else []))
    assert t.optimize(partition={"site": "b"})["partitions_compacted"] == 0
    assert t.optimize() == {"partitions_compacted": 1, "files_removed": 5, "files_added": 1, "partitions_skipped": 0}
    assert ids(t.read()) == [0, 1, 2, 3, 4, 10, 11]
    assert t.vacuum() == {"deleted": 0, "candidates": 0}
    paths = t.vacuum(0, dry_run=True)["candidates"]
    assert len(paths) == 5
    assert t.vacuum(0) == {"deleted": 5, "candidates": 5}
    assert t.vacuum(0) == {"deleted": 0, "candidates": 0}
    assert ids(t.read()) == [0, 1, 2, 3, 4, 10, 11]
    with pytest.raises(VersionExpired):
        t.read(version=5)
    assert ids(t.query().at(version=5).filter(site="b").df()) == [10, 11]
    assert t.version() == 6


def test_large_partitions_are_split(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec(partition_by=("site",), target_file_size_mb=0.2))
    rows = spark.range(60000).select(F.col("id"), F.lit("a").alias("site"), F.lit(DAY).alias("day"), F.rand(1).alias("value"), F.expr("uuid()").alias("note"))
    for _ in range(2):
        t.append(rows.limit(300))
    t.optimize(2)
    t.append(rows)
    assert t.query().count() == 60600


def test_auto_compact(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec(partition_by=("site",), auto_compact_threshold=3))
    for k in range(3):
        add(t, row(k))
    assert t.totals() | {"bytes": 0} == {"files": 1, "rows": 3, "bytes": 0}


# the log


def test_racing_writers_lose_nothing(spark, tmp_path):
    root, errors = str(tmp_path), []
    Table(spark, root, spec(partition_by=("site",)))

    def write(k):
        try:
            t = Table(spark, root, spec(partition_by=("site",)))
            for j in range(3):
                add(t, row(100 * k + j, "ab"[k % 2]))
        except Exception as error:
            errors.append(error)

    def tidy():
        try:
            t = Table(spark, root, spec(partition_by=("site",)))
            for _ in range(3):
                t.optimize(2)
                t.delete_where(field("id") == 100)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)] + [threading.Thread(target=tidy)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors
    t = Table(spark, root, spec(partition_by=("site",)))
    t.delete_where(field("id") == 100)
    assert ids(t.read()) == sorted(100 * k + j for k in range(4) for j in range(3) if 100 * k + j != 100)


def test_conflicts_are_seen(table):
    add(table, row(1))
    path = table.snapshot()[0].path
    table.log.commit("delete", {}, [], [path])
    with pytest.raises(ConcurrentModification):
        table.log.commit("delete", {}, [], [path])


def test_checkpoints_bound_replay(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec())
    for k in range(45):
        t.log.commit("append", {}, [File(f"t/f{k}", 1, 1)], [f"t/f{k - 1}"] if k else [])
    fresh = Table(spark, str(tmp_path), spec())
    reads = []
    plain = fresh.store.read
    fresh.store.read = lambda name: reads.append(name) or plain(name)
    assert [f.path for f in fresh.snapshot()] == ["t/f44"]
    assert len([r for r in reads if r.endswith(".json")]) < 10
    assert [f.path for f in fresh.snapshot(7)] == ["t/f6"]
    assert (fresh.log.committed_at(30) < fresh.log.committed_at(31)) and fresh.log.resolve(as_of=fresh.log.committed_at(30)) == 30


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_stores(spark, tmp_path, kind):
    store = LocalStore(str(tmp_path)) if kind == "local" else HadoopStore(spark, f"file://{tmp_path}")
    assert store.read("a/x") is None and store.names("a") == []
    assert store.publish("a/x", "one") and not store.publish("a/x", "two")
    assert store.read("a/x") == "one"
    store.replace("a/x", "three")
    store.move("a/x", "b/c/y")
    assert store.names("b/c") == ["y"] and store.read("b/c/y") == "three"
    store.delete("b")
    assert store.read("b/c/y") is None


def test_buffer_shares_commits(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec(write_buffer_ms=400))
    versions = []
    threads = [threading.Thread(target=lambda k=k: versions.append(add(t, row(k)))) for k in range(5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(versions) == 5 and len(set(versions)) == t.version() < 5
    assert ids(t.read()) == list(range(5))


def test_import(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec(stats_columns=("value", "site")))
    df = spark.createDataFrame([row(k, s, d, value=float(k)) for k, (s, d) in enumerate([("a b", 0), ("a+b", 1), ("5%", 0), (None, 1)])], SCHEMA)
    df.write.partitionBy("site", "day").parquet(f"{tmp_path}/lake/one")
    df.where("site IS NOT NULL").withColumn("id", F.col("id") + 10).withColumns({"p": F.col("site"), "q": F.col("day")}).write.partitionBy("p", "q").parquet(f"{tmp_path}/lake/two")
    assert t.import_existing("lake") == 1
    assert ids(t.read()) == [0, 1, 2, 3, 10, 11, 12]
    for s, want in (("a b", [0, 10]), ("a+b", [1, 11]), ("5%", [2, 12]), (None, [3])):
        assert ids(t.query().filter(field("site") == s).df()) == want
        assert len(t.query().filter(field("site") == s).files()) == len(want)
    with pytest.raises(LoamError, match="no new"):
        t.import_existing("lake")
    with pytest.raises(ValueError, match="folder"):
        t.import_existing("")
    t.update_where(field("id") == 0, note="n")
    assert t.delete_where(field("value") == 2.0)["rows_affected"] == 2
    assert ids(t.read()) == [0, 1, 3, 10, 11]


def test_import_of_mixed_files(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec(partition_by=("site",)))
    rows = [row(1, "a"), row(2, "b"), row(3, "b"), row(4, None), row(5, "")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/lake/mixed")
    spark.createDataFrame([row(6, "b"), row(7, "b")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/lake/pure")
    spark.createDataFrame([row(8, "c"), row(9, None)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/lake/some_null")
    with pytest.raises(LoamError, match="several partitions"):
        t.import_existing("lake")
    assert t.version() == 0
    t.import_existing("lake", rewrite_mixed=True)
    assert ids(t.read()) == list(range(1, 10))
    assert ids(t.query().filter(site="b").df()) == [2, 3, 6, 7]
    assert t.delete_where(site="a") == {"version": 2, "files_rewritten": 1, "rows_affected": 1}
    assert t.delete_where(field("site").is_nil())["rows_affected"] == 2
    assert ids(t.read()) == [2, 3, 5, 6, 7, 8]


def test_statistics_of_columns_declared_later(spark, tmp_path):
    old = Table(spark, str(tmp_path), spec(partition_by=("site",), stats_columns=()))
    for k in range(4):
        add(old, row(k, "ab"[k % 2], value=float(k)))
    t = Table(spark, str(tmp_path), spec(partition_by=("site",), stats_columns=("value",)))
    q = t.query().filter(field("value") > 2.5)
    assert len(q.files()) == 4
    assert t.backfill_statistics() == 5
    assert t.backfill_statistics() is None
    assert len(q.files()) == 1 and ids(q.df()) == [3]
    assert t.vacuum(0) == {"deleted": 0, "candidates": 0}
    assert ids(t.read()) == [0, 1, 2, 3]


def test_files_that_no_commit_names_go(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path), spec(partition_by=("site",)))
    add(t, row(1))

    def broken(*_, **__):
        raise OSError("no connection")

    with monkeypatch.context() as m:
        m.setattr(t.log, "commit", broken)
        with pytest.raises(OSError, match="connection"):
            add(t, row(2))
    os.makedirs(f"{tmp_path}/t/_staging/draft")
    for name in ("t/_staging/draft/x.parquet", "t/mine.parquet"):
        open(f"{tmp_path}/{name}", "w").close()
    assert t.vacuum() == {"deleted": 0, "candidates": 0}  # they may be another writer's, not yet committed
    for path, _ in list(t.store.walk("t")):
        os.utime(f"{tmp_path}/{path}", (1, 1))
    assert len(t.vacuum(24, dry_run=True)["candidates"]) == 2
    assert t.vacuum(24)["deleted"] == 2
    assert ids(t.read()) == [1]
    assert os.path.exists(f"{tmp_path}/t/mine.parquet")


def test_an_append_stands_whatever_compaction_does(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path), spec(partition_by=("site",), auto_compact_threshold=2))

    def broken(*_, **__):
        raise RuntimeError("no room")

    monkeypatch.setattr(t, "optimize", broken)
    assert [add(t, row(k)) for k in range(3)] == [1, 2, 3]
    assert len(t.compaction_errors) == 3 and ids(t.read()) == [0, 1, 2]
    later = Table(spark, str(tmp_path), spec(partition_by=("site",), auto_compact_threshold=2, auto_compact_async=True))
    add(later, row(3), row(10, "b"))
    later.wait_for_compaction()
    assert later.totals()["files"] == 2 and ids(later.read()) == [0, 1, 2, 3, 10]


def test_states_are_kept_in_checkpoints(spark, tmp_path):
    t = Table(spark, str(tmp_path), spec())
    for k in range(41):
        t.log.commit("append", {}, [File(f"t/part-{k:032x}.parquet", 1, 1)], [f"t/part-{k - 1:032x}.parquet"] if k else [], txn={"app": f"a{k % 3}", "batch": k}, watermarks={"s": k})
    t.store.replace("t/_log/swept.txt", "10")
    for _ in range(20):
        t.log.commit("note", {})
    fresh = Table(spark, str(tmp_path), spec())
    assert [fresh.log.last_batch(f"a{k}") for k in range(4)] == [39, 40, 38, -1]
    assert fresh.log.watermarks() == {"s": 40}
    assert sorted(fresh.log.state().removed.values()) == list(range(11, 42))
    assert len(fresh.log._records) < 10
    t.store.replace(t.log._name(60, "checkpoint"), "[]")  # of the older form
    assert Table(spark, str(tmp_path), spec()).log.watermarks() == {"s": 40}


# views

DAILY = struct(site=TEXT, day=DATE, n=LONG, high=LONG)
QUERY = "SELECT site, day, count(*) AS n, count(*) FILTER (WHERE source.value > 2) AS high FROM source GROUP BY site, day"


def daily(t, name="daily", **options):
    options = {"partition_by": ("site", "day"), "refresh": "partition_incremental"} | options
    return View(t.spark, t.store.root, ViewSpec(name, DAILY, sources={"source": t}, query=QUERY, **options))


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_incremental_refresh(table):
    view = daily(table)
    by_site = View(table.spark, table.store.root, ViewSpec("site", struct(site=TEXT, n=LONG), sources={"s": table}, query="SELECT site, count(*) AS n FROM s GROUP BY site", partition_by=("site",), refresh="partition_incremental"))
    assert view.refresh()["partitions"] == 0
    r = random.Random(6)
    for step in range(5):
        add(table, *[row(step * 10 + k, r.choice(["a", "b", None]), r.randint(0, 2), value=float(k)) for k in range(3)])
        if step == 3:
            table.delete_where(site="a")
        done = view.refresh()
        assert done["strategy"] == "partition_incremental" and done["watermarks"] == {"source": table.version()}
        by_site.refresh()
        whole = daily(table, f"whole{step}", refresh="recompute")
        whole.refresh()
        assert rows_of(view.read()) == rows_of(whole.read())
        assert dict(map(tuple, by_site.read().collect())) == {s: n for s, n in table.read().groupBy("site").count().collect()}
    assert view.refresh() == "up_to_date"
    assert view.refresh("recompute")["files_removed"] > 0
    table.log.commit("note", {})
    done = view.refresh()
    assert (done["rows_written"], done["files_added"]) == (0, 0)
    assert view.history(1).first()["operation"] == "refresh_watermark"
    assert view.refresh() == "up_to_date"


def test_only_changed_partitions_are_made_anew(table):
    view = daily(table)
    add(table, row(1, "a"), row(2, "b"))
    view.refresh()
    before = {f.path for f in view.snapshot()}
    add(table, row(3, "b"))
    assert view.refresh()["partitions"] == 1
    after = {f.path for f in view.snapshot()}
    assert len(before & after) == 1 and len(after - before) == 1


def test_views_refuse(table):
    view = daily(table)
    for change in (lambda: view.append(None), lambda: view.create(), lambda: view.delete_where(True), lambda: view.update_where(True, n=1), lambda: view.import_existing("x")):
        with pytest.raises(ViewIsReadOnly):
            change()
    with pytest.raises(ValueError, match="isn't partitioned"):
        View(table.spark, table.store.root, ViewSpec("v", SCHEMA, sources=[table], query="x", partition_by=("note",), refresh="partition_incremental"))
    with pytest.raises(ValueError, match="needs partition_by"):
        daily(table, "w", partition_by=())


def test_views_on_views_and_empty_sources(table):
    days = daily(table)
    top = View(table.spark, table.store.root, ViewSpec("top", struct(most=LONG), sources=[days], query="SELECT max(n) AS most FROM daily"))
    refresh_all([top, days])
    assert [r["most"] for r in top.read().collect()] == [None]
    add(table, row(1), row(2))
    assert list(refresh_all([top, days])) == ["daily", "top"]
    assert top.read().first()["most"] == 2
    top.refresh()
    top.vacuum(0)
    assert top.read().first()["most"] == 2


def test_worker_joins_bursts(table):
    view = daily(table)
    add(table, row(1))
    worker = RefreshWorker(view, max_staleness=60, min_interval_ms=300).start()
    for _ in range(20):
        worker.notify()
    end = time.time() + 20
    while worker.refreshed < 1 and time.time() < end:
        time.sleep(0.1)
    time.sleep(0.6)
    worker.stop()
    assert worker.refreshed == 1 and not worker.errors
    assert view.read().count() == 1


def test_worker_survives_and_tells(table):
    bad = View(table.spark, table.store.root, ViewSpec("bad", struct(n=LONG), sources={"source": table}, query="SELECT nope AS n FROM source"))
    add(table, row(1))
    told = []
    worker = RefreshWorker(bad, max_staleness=60, min_interval_ms=1, on_error=told.append).start()
    end = time.time() + 20
    while len(worker.errors) < 2 and time.time() < end:
        worker.notify()
        time.sleep(0.1)
    bad.spec = daily(table).spec
    while worker.refreshed < 1 and time.time() < end:
        worker.notify()
        time.sleep(0.1)
    worker.stop()
    assert len(worker.errors) >= 2 and len(told) == len(worker.errors) and worker.refreshed >= 1


def test_options_set_by_several_threads_are_put_back(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before, entered = spark.conf.get(name, None), threading.Barrier(4)

    def hold(k):
        with files.settings(spark, {name: "false"}):
            entered.wait()
            time.sleep(0.05 * k)
            assert spark.conf.get(name) == "false"

    threads = [threading.Thread(target=hold, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert spark.conf.get(name, None) == before


# streams


def test_batches_are_written_once(spark, table):
    write = batch_writer(table, "app")
    df = spark.createDataFrame([row(1)], SCHEMA)
    for number in (0, 0, 1, 1, 0):
        write(df, number)
    assert table.read().count() == 2
    batch_writer(table, "other")(df, 0)
    assert table.read().count() == 3


def test_stream_and_windows(spark, table, tmp_path):
    add(table, *[row(k, "ab"[k % 2]) for k in range(20)])
    source = f"{tmp_path}/source"
    table.read().write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    target = Table(spark, str(tmp_path), spec("target"))
    for _ in range(2):
        append_stream(stream, target, "s", f"{tmp_path}/c").awaitTermination()
    assert ids(target.read()) == list(range(20))
    for name, counted in (("w", windowed_counts(stream.withColumn("at", F.col("at").cast("timestamp")), "at", ["site"], "10 minutes", "1 hour")), ("x", session_counts(stream.withColumn("at", F.col("at").cast("timestamp")), "at", ["site"], "5 minutes", "1 hour"))):
        q = counted.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
    assert sorted((r["site"], r["n"]) for r in spark.table("w").collect()) == [("a", 5), ("a", 5), ("b", 5), ("b", 5)]


def test_change_feed(table):
    add(table, row(1, value=1.0), row(2, value=2.0), row(3, "b"))
    start = table.version()
    table.delete_where(field("id") == 1)
    add(table, row(4))
    table.update_where(field("id") == 2, value=7.0)
    table.optimize(1)
    got = sorted((r["id"], r["_change"], r["value"]) for r in table.changes(start).collect())
    assert got == [(1, "delete", 1.0), (2, "delete", 2.0), (2, "insert", 7.0), (4, "insert", 1.0)]


def test_change_feed_of_maps(spark, tmp_path):
    kind = T.MapType(TEXT, T.ArrayType(T.MapType(LONG, TEXT)))
    schema = struct(id=LONG, m=kind, s=struct(inner=kind, x=LONG))
    t = Table(spark, str(tmp_path), TableSpec("maps", schema))
    rows = [(k, {"b": [{k: "x", 0: None}], "a": None}, ({"z": []}, k)) for k in range(3)] + [(9, None, None)]
    t.append(spark.createDataFrame(rows, schema))
    t.update_where(field("id") == 1, id=11)
    got = {(r["id"], r["_change"]): (r["m"], r["s"] and tuple(r["s"])) for r in t.changes(1).collect()}
    assert got == {(1, "delete"): rows[1][1:], (11, "insert"): rows[1][1:]}
    assert sorted(r["id"] for r in t.changes(0, 1).collect()) == [0, 1, 2, 9]


def test_types_roundtrip():
    for value, kind in ((NAN, T.DoubleType()), (DAY, T.DateType()), (dt.datetime(2026, 1, 1, 2, 3, 4, 5), T.TimestampNTZType()), (decimal.Decimal("1.50"), T.DecimalType(10, 2)), (True, T.BooleanType()), (None, T.StringType()), (2**60, T.LongType())):
        back = types.decode(types.encode(value), kind)
        assert back == value or str(back) == str(value)


def test_zones_of_the_machine_do_not_matter(spark, tmp_path, monkeypatch):
    """Times mean the same in rows, filters and statistics, whatever TZ says."""
    schema = struct(id=LONG, at=TIME, zoned=T.TimestampType())
    rows = spark.range(48).select("id", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))").alias("at")).withColumn("zoned", F.col("at").cast("timestamp"))
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        t = Table(spark, str(tmp_path), TableSpec("zones", schema, stats_columns=("at", "zoned")))
        for part in (rows.where("id < 24"), rows.where("id >= 24")):
            t.append(part)
        noon = dt.datetime(2026, 1, 1, 12)
        for column in ("at", "zoned"):
            assert ids(t.query().filter(field(column) <= noon).df()) == list(range(13))
            assert len(t.query().filter(field(column) <= noon).files()) == 1
            assert ids(t.query().filter(field(column).one_of(noon, noon.replace(tzinfo=dt.UTC))).df()) == [12]
        t.update_where(field("id") == 0, at=noon, zoned=noon)
        assert t.read().where("id = 0 AND at = timestamp_ntz'2026-01-01 12:00:00' AND zoned = at").count() == 1
    finally:
        monkeypatch.undo()
        time.tzset()
