"""What both vector searches share: which vectors take part, equal vectors as one, blocks of queries and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, and queries, that a task multiplies at once.
ROWS_BLOCK = 4096
QUERIES_BLOCK = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero_too: bool) -> DataFrame:
    """id long, v array<double>: vectors that are neither null nor empty nor hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(fine & F.col("id").isNotNull())
    return rows if zero_too else rows.where(F.exists("v", lambda x: x != 0))


def merged(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids: every different vector with its `keep` smallest ids (repeats counted), smallest first.

    No search for fewer than `keep` rows needs more of them, and a vector that a third of all rows hold is one row.
    """
    by = [F.xxhash64("v").alias("g"), F.col("v"), F.col("id")]
    order = Window.partitionBy("g", "v").orderBy("id")
    few = rows.select(*by).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    return few.groupBy("g", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).drop("g")


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """The vectors of a column, all of one length, as rows."""
    values = table[column].combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def in_blocks(rows: DataFrame, queries: DataFrame, cell: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and queries of each cell, dealt out so that every query meets every row of its cell in just one block.

    Both get at most about ROWS_BLOCK and QUERIES_BLOCK rows a block; a cell of any size is many blocks. The table of
    cells' sizes is as small as the number of cells.
    """
    grid = rows.groupBy(*cell).agg(F.ceil(F.count("*") / ROWS_BLOCK).cast("int").alias("nr"))
    grid = grid.join(queries.groupBy(*cell).agg(F.ceil(F.count("*") / QUERIES_BLOCK).cast("int").alias("nq")), cell)

    def dealt(frame: DataFrame, key: Column, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        frame = frame.join(F.broadcast(grid), cell)
        frame = frame.withColumn(own, F.pmod(F.xxhash64(F.lit(own), key), F.col(mine)).cast("int"))
        return frame.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop("nr", "nq")

    block = [*cell, "rb", "qb"]
    return dealt(rows, F.element_at("ids", 1), "rb", "qb", "nr", "nq"), dealt(queries, F.col("id"), "qb", "rb", "nq", "nr"), block


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; found: id, score, ids. A query is not its own candidate.

    Equal scores go by the smaller id. Scores of floating-point products are equal if all their bits are: for different
    vectors whose exact products tie, the order of a product's sums decides.
    """
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), F.element_at("ids", 1))
    few = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    rows = few.select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
