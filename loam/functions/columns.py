"""Column expressions that views and queries use often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_number(column: str, key: str) -> Column:
    """A field of a JSON text as double; null if it is missing."""
    return F.get_json_object(F.col(column), f"$.{key}").cast("double")


def exact_sum(column: str | Column, digits: int = 2) -> Column:
    """A sum of doubles that doesn't depend on their order: added as decimals, returned as double."""
    value = F.col(column) if isinstance(column, str) else column
    return F.sum(value.cast(f"decimal(18,{digits})")).cast("double")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the newest right row of the same keys at or before its time; others drop.

    Both sides are put in one order by key and time and the last right row is carried forward: one shuffle by key,
    no pairs. A tie in time takes the greatest values.
    """
    marked = "__right"
    a = left.select("*", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias(marked), F.col(left_time).alias("__time"), F.lit(1).alias("__side"))
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.struct(*values).alias(marked), F.col(right_time).alias("__time"), F.lit(0).alias("__side"))
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("__time", "__side", F.col(marked)).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last(marked, ignorenulls=True).over(order))
    return both.where("__side = 1 AND __last IS NOT NULL").select(*left.columns, "__last.*")
