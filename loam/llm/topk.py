"""Exact top-k by inner product over integer vectors, with a pivot-distance index.

With M the largest norm, a row v is taken as (v, sqrt(M^2 - |v|^2)) and a query q as (q, 0): then distance^2 is
|q|^2 + M^2 - 2 q.v, so the nearest rows are those of the largest product. Each row is keyed by its nearest pivot and
its distance to it, and a pivot's rows are sorted by that distance. A query at distance d from a pivot expands the
annuli around d outwards, a slab at a time on the side that can still be nearer, and stops when |d - r| exceeds the
distance of its k-th best so far: by the triangle inequality no further row can be better. A first pass in the query's
own pivot's cell gives that bound; the second visits the cells that the bound doesn't exclude.

Pivots are PIVOTS-th-root sampled rows (by a hash of ids); any choice gives the same results. Null and empty vectors,
and those with null or non-finite components, take no part, nor do rows with a null id. Equal vectors are one row
with their smallest ids; ties go to the smaller id. Vectors are compared with those of the same length. Components
and scores must fit 64 bits; scores are exact integers (products beyond 2^53 are summed as integers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import vectors
from loam.llm._common import prepare, settle

K = 5
SLAB = 512
MOST_PIVOTS = 1024


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x . q in integers, by floating point where that is exact."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2**53:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def _expand(x: np.ndarray, radius: np.ndarray, ids: np.ndarray, q: np.ndarray, d: float, reach2: float, best: int | None, k: int) -> list[tuple[int, int]]:
    """(score, row) of the k best rows that reach `best`, scanning annuli outwards from d; reach2 is |q|^2 + M^2."""
    scores, rows = np.empty(0, np.int64), np.empty(0, np.int64)
    right = int(np.searchsorted(radius, d))
    left = right
    bound = best
    while left > 0 or right < len(radius):
        gap_left = d - radius[left - 1] if left else np.inf
        gap_right = radius[right] - d if right < len(radius) else np.inf
        if bound is not None:
            distance = np.sqrt(max(0.0, reach2 - 2.0 * bound))
            if min(gap_left, gap_right) > distance * (1 + 1e-9) + 1e-6:
                break
        if gap_left <= gap_right:
            begin, end = max(0, left - SLAB), left
            left = begin
        else:
            begin, end = right, min(len(radius), right + SLAB)
            right = end
        new = _products(x[begin:end], q)
        at = np.arange(begin, end)
        if bound is not None:
            at, new = at[new >= bound], new[new >= bound]
        if len(new):
            scores, rows = np.concatenate([scores, new]), np.concatenate([rows, at])
            order = np.lexsort((ids[rows], -scores))[:k]
            scores, rows = scores[order], rows[order]
            if len(scores) == k:
                bound = max(int(scores[-1]), -(1 << 62) if bound is None else bound)
    return list(zip(scores.tolist(), rows.tolist(), strict=True))


def _augmented(x: np.ndarray, most2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, most2 - (x * x).sum(1, keepdims=True)))])


def search(embeddings: DataFrame, every: int = 50, k: int = K, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest product for each row whose id `every` divides."""
    prepare(embeddings.sparkSession)
    floats = vectors.usable(embeddings, id_col, vector_col, zero_too=True)
    rows = settle(floats.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v")), "integers")
    unique = settle(vectors.merged(rows, k + 1).withColumn("dim", F.size("v")), "unique")
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = unique.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm2).alias("most2")).collect()  # one row a length
    centres: dict[int, tuple[np.ndarray, float]] = {}
    for r in stats:
        many = pivots or max(2, min(MOST_PIVOTS, round(r["n"] ** (1 / 3))))
        chosen = unique.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit("pivot"), F.element_at("ids", 1))).limit(many).select("v").collect()
        centres[r["dim"]] = (_augmented(np.array([c["v"] for c in chosen], float), r["most2"]), r["most2"])

    def keyed(by: str, query: bool):
        def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in given:
                table = pa.Table.from_batches([batch])
                dims = table["dim"].to_numpy()
                nearest, distance = np.zeros(len(dims), np.int32), [np.empty(0)] * len(dims)
                for dim in np.unique(dims).tolist():
                    centre, most2 = centres[dim]
                    at = np.flatnonzero(dims == dim)
                    x = vectors.matrix(table.take(pa.array(at)), "v")
                    x = np.hstack([x, np.zeros((len(x), 1))]) if query else _augmented(x, most2)
                    away = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (centre * centre).sum(1)[None, :] - 2 * x @ centre.T))
                    nearest[at] = away.argmin(1)
                    for i, row in zip(at.tolist(), away, strict=True):
                        distance[i] = row
                out = {by: batch.column(by), "v": batch.column("v"), "dim": batch.column("dim"), "cell": pa.array(nearest, pa.int32())}
                if query:
                    out["away"] = pa.array([x.tolist() for x in distance], pa.list_(pa.float64()))
                else:
                    out["radius"] = pa.array([float(x[c]) for x, c in zip(distance, nearest, strict=True)], pa.float64())
                yield pa.RecordBatch.from_pydict(out)

        return batches

    index = settle(unique.select("ids", "v", "dim").mapInArrow(keyed("ids", False), "ids array<bigint>, v array<double>, dim int, cell int, radius double"), "index")
    asked = rows.where(F.col("id") % every == 0).withColumn("dim", F.size("v")).select("id", "v", "dim")
    asked = settle(asked.mapInArrow(keyed("id", True), "id bigint, v array<double>, dim int, cell int, away array<double>"), "asked")

    def scan(_: tuple, queries: pa.Table, mine: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and mine.num_rows:
            order = np.argsort(mine["radius"].to_numpy(), kind="stable")
            mine = mine.take(pa.array(order))
            x, radius = vectors.matrix(mine, "v"), mine["radius"].to_numpy()
            least = np.array([i[0] for i in mine["ids"].to_pylist()])
            most2 = centres[x.shape[1]][1]
            q, d, best = vectors.matrix(queries, "v"), queries["d"].to_numpy(), queries["best"].to_pylist()
            for i, name in enumerate(queries["id"].to_pylist()):
                found = _expand(x, radius, least, q[i], float(d[i]), float(q[i] @ q[i]) + most2, best[i], k + 1)
                out += [(name, score, row) for score, row in found]
        ids, scores, places = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64()), "ids": mine["ids"].take(pa.array(places, pa.int64()))})

    def visit(queries: DataFrame) -> DataFrame:
        mine, queries, block = vectors.in_blocks(index, queries, ["dim", "cell"])
        return queries.groupBy(*block).cogroup(mine.groupBy(*block)).applyInArrow(scan, "id bigint, score bigint, ids array<bigint>")

    own = asked.select("id", "v", "dim", "cell", F.get("away", F.col("cell")).alias("d"), F.lit(None).cast("bigint").alias("best"))
    first = settle(visit(own), "first")
    bound = vectors.ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("best"))
    reach = index.groupBy("dim", "cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high"))
    rest = asked.join(bound, F.col("id") == F.col("q"), "left").select("id", "v", "dim", F.col("cell").alias("own"), "best", F.posexplode("away").alias("cell", "d"))
    most2 = F.coalesce(*[F.when(F.col("dim") == n, F.lit(float(m))) for n, (_, m) in centres.items()], F.lit(0.0))
    distance = F.sqrt(F.greatest(F.lit(0.0), norm2 + most2 - 2.0 * F.col("best")))
    gap = F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d"))
    rest = rest.where("cell <> own").join(F.broadcast(reach), ["dim", "cell"])
    rest = rest.where(F.col("best").isNull() | (gap <= distance * (1 + 1e-9) + 1e-6)).select("id", "v", "dim", "cell", "d", "best")
    second = visit(settle(rest, "rest"))
    return vectors.ranked(first.union(second), k)
