"""What a task holds: the plans that ran have no step whose rows or states grow with what one task reads."""

import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam import queries
from loam.operators.table import Table
from loam.plans.expr import field
from loam.plans.types import TableSpec


def plans(spark, action):
    """The plans of all that Spark ran during an action, as text."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    before = store.executionsCount()
    action()
    bus.waitUntilEmpty()
    every = store.executionsList()
    return [every.apply(k).physicalPlanDescription() for k in range(before, every.size())]


def steps(plan, kind):
    """The descriptions of a plan's steps of a kind."""
    return [s for s in re.split(r"\n\s*\n", plan) if re.match(rf"\s*\(\d+\) {kind}\b", s)]


def test_no_sketch_for_each_user(spark, small):
    found = plans(spark, lambda: queries.view_approx_distinct(spark, small))
    aggregates = [s for p in found for s in steps(p, r"\w*Aggregate") if "approx_count_distinct" in s]
    assert aggregates
    assert not [s for s in aggregates if re.search(r"Keys[^\n]*user_id", s)]


def test_sketches_of_distinct_pairs(spark):
    """The view's query gives what the one over all rows gives, nulls included."""
    spark.range(3000).selectExpr("nullif(concat('t', id % 4), 't3') AS event_type", "CASE WHEN id % 4 <> 2 THEN nullif(id * id % 701, 1) END AS user_id").createOrReplaceTempView("some_events")
    over = "SELECT event_type, approx_count_distinct(user_id, 0.02) AS about, count({}) AS n FROM {} GROUP BY event_type ORDER BY event_type"
    whole = spark.sql(over.format("DISTINCT user_id", "some_events")).collect()
    assert spark.sql(over.format("user_id", "(SELECT DISTINCT event_type, user_id FROM some_events)")).collect() == whole
    assert [r.n for r in whole if r.event_type == "t2"] == [0]


TEXTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("flag", T.StringType()), T.StructField("note", T.StringType()), T.StructField("value", T.DoubleType())])


def texts(spark, rows, flags):
    return spark.range(rows).selectExpr("id", f"nullif(concat('f', id % {flags}), 'f1') AS flag", "CASE WHEN id % 7 > 0 THEN concat('n', id * 7919 % 1000) END AS note", "CAST(id % 40 AS DOUBLE) AS value")


def test_nothing_is_sorted_for_statistics_or_partitions(spark, tmp_path):
    table = Table(spark, str(tmp_path), TableSpec("t", TEXTS, partition_by=("flag",), stats_columns=("note", "value")))

    def change():
        table.append(texts(spark, 3000, 3))
        table.delete_where(field("value") > 25.0)

    found = plans(spark, change)
    assert sum("InsertIntoHadoopFsRelationCommand" in p for p in found) == 2
    assert not [s for p in found for s in steps(p, r"Sort\w*")]
    rows = texts(spark, 3000, 3).where("value <= 25")
    wanted = {r.flag: r for r in rows.groupBy("flag").agg(F.min("note").alias("a"), F.max("note").alias("b"), F.count("note").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    kept = table.snapshot()
    assert len(kept) == 3
    for f in kept:
        r = wanted[f.values(table.spec, ("flag",))[0]]
        assert (f.rows, f.stats["note"]) == (r.rows, [r.a, r.b, r.rows - r.n])
    for a, b in zip(table.read().orderBy("id").collect(), rows.orderBy("id").collect(), strict=True):
        assert a == b
    least = min(r.a for r in wanted.values())
    assert table.query().filter(note=least).count() == rows.where(F.col("note") == least).count() > 0


def test_more_partitions_than_files_open_at_once(spark, tmp_path):
    """8 tasks for 300 partitions: each has more of them than it opens files for at once."""
    table = Table(spark, str(tmp_path), TableSpec("t", TEXTS, partition_by=("flag",), stats_columns=("note",)))
    table.append(texts(spark, 6000, 300))
    assert sorted(table.read().collect(), key=lambda r: r.id) == texts(spark, 6000, 300).orderBy("id").collect()
    assert Counter(f.values(table.spec, ("flag",))[0] for f in table.snapshot()) == Counter([None, *(f"f{k}" for k in range(300) if k != 1)])


def test_sorted_tables_stay_sorted(spark, tmp_path):
    table = Table(spark, str(tmp_path), TableSpec("t", TEXTS, partition_by=("flag",), sort_within_files=("note", "id")))
    table.append(texts(spark, 3000, 40))
    for f in table.snapshot():
        found = [((r.note is None, r.note), r.id) for r in table.read_files([f]).coalesce(1).collect()]
        assert found == sorted(found)
