"""Approximate nearest neighbours by learned partitions, for the largest inner product.

Fit, on a bounded sample (SAMPLE vectors by a hash of their ids): the graph of each vector's nearest neighbours is cut
into balanced partitions by capacity-bound label propagation, and a softmax classifier learns to tell a vector's
partition. Index: every row goes to its likeliest partition. Search: a query goes to its PROBES likeliest partitions
- as many as reach RECALL on the sample - and all their rows are reranked by the exact inner product.

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows with a null id.
Equal vectors are one row with their smallest ids; ties go to the smaller id; repeated ids count as rows of their
own. Vectors are compared with those of the same length; lengths other than the sample's commonest are one cell each,
searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import vectors
from loam.llm._common import prepare, settle

SAMPLE = 4096
NEIGHBOURS = 12
SWEEPS = 12
RECALL = 0.96
K = 20


@dataclass(frozen=True)
class Router:
    """A linear softmax classifier of partitions, and how many of them a query is sent to."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row of x, the likeliest first."""
        scale = np.linalg.norm(x, axis=1, keepdims=True)
        return np.argsort(-(x / np.where(scale > 0, scale, 1) @ self.weights + self.bias), axis=1, kind="stable")


def partition_graph(near: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """A cell for each node of a neighbour graph, balanced to 5 %, with few edges between cells."""
    n = len(near)
    random, most = np.random.default_rng(seed), int(np.ceil(1.05 * n / cells))
    around: list[list[int]] = [list(x) for x in near.tolist()]
    for i, x in enumerate(near.tolist()):
        for j in x:
            around[j].append(i)
    cell, size = np.full(n, -1), np.zeros(cells, int)
    queue: list[list[int]] = [[int(x)] for x in random.choice(n, cells, replace=n < cells)]
    fresh = iter(random.permutation(n).tolist())
    for _ in range(n):  # grow all cells by turns, breadth first
        k = int(np.argmin(size))
        node = next((x for x in iter(lambda k=k: queue[k].pop(0) if queue[k] else -1, -1) if cell[x] < 0), None)
        if node is None:
            node = next(x for x in fresh if cell[x] < 0)
        cell[node] = k
        size[k] += 1
        queue[k].extend(x for x in around[node] if cell[x] < 0)
    for _ in range(SWEEPS):
        moved = 0
        for i in random.permutation(n).tolist():
            votes = np.bincount(cell[around[i]], minlength=cells)
            votes[size >= most] = -1
            votes[cell[i]] = np.count_nonzero(cell[around[i]] == cell[i])
            to = int(np.argmax(votes))
            if votes[to] > votes[cell[i]]:
                size[cell[i]] -= 1
                size[to] += 1
                cell[i] = to
                moved += 1
        if moved < n / 200:
            break
    return cell


def fit(sample: np.ndarray, cells: int, recall: float = RECALL) -> Router:
    """Cuts the sample's neighbour graph, learns its partitions, and sets the probes."""
    n = len(sample)
    cells = max(1, min(cells, n // 8))
    if cells < 2:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), 1)
    near = np.empty((n, min(K, n - 1)), np.int64)
    for at in range(0, n, 512):
        scores = sample[at : at + 512] @ sample.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        near[at : at + 512] = np.argsort(-scores, axis=1, kind="stable")[:, : near.shape[1]]
    cell = partition_graph(near[:, :NEIGHBOURS], cells)
    scale = np.linalg.norm(sample, axis=1, keepdims=True)
    x, gold = sample / np.where(scale > 0, scale, 1), np.eye(cells)[cell]
    now = np.zeros((x.shape[1] + 1, cells))
    mean, square = np.zeros_like(now), np.zeros_like(now)
    one = np.hstack([x, np.ones((n, 1))])
    for step in range(1, 201):
        logits = one @ now
        chance = np.exp(logits - logits.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        slope = one.T @ (gold - chance) / n - 1e-4 * now
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        now = now + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    router = Router(now[:-1], now[-1], cells)
    order = router.order(sample)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(cells)[None, :], 1)
    reached = np.take_along_axis(rank, order[near, 0], 1)  # the turn at which each neighbour's cell comes
    share = [(reached < p).mean() for p in range(1, cells + 1)]
    return Router(router.weights, router.bias, next(p for p, s in enumerate(share, 1) if s >= recall or p == cells))


def search(embeddings: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose id `every` divides."""
    spark = prepare(embeddings.sparkSession)
    rows = settle(vectors.usable(embeddings, id_col, vector_col, zero_too=False), "vectors")
    unique = settle(vectors.merged(rows, k + 1).withColumn("dim", F.size("v")), "unique")
    total = unique.count()
    head = unique.select("dim", "v", F.xxhash64(F.lit("ann"), F.element_at("ids", 1)).alias("h")).orderBy("h").limit(SAMPLE).collect()  # the documented bound of the fit
    dims = [r["dim"] for r in head]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    sample = np.array([r["v"] for r in head if r["dim"] == dim], float).reshape(dims.count(dim), dim)
    router = fit(sample, cells or max(4, min(1024, round(total ** (1 / 3)))), recall)

    def routed(probes: int, by: str):
        def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in given:
                table = pa.Table.from_batches([batch])
                mine = table["dim"].to_numpy() == dim
                to = np.full((len(mine), probes), -1, np.int32)
                to[mine, 1:] = -2
                if mine.any():
                    to[mine] = router.order(vectors.matrix(table.filter(pa.array(mine)), "v"))[:, :probes]
                yield pa.RecordBatch.from_pydict({by: batch.column(by), "v": batch.column("v"), "dim": batch.column("dim"), "to": pa.array([[c for c in x if c >= -1][: None if m else 1] for x, m in zip(to.tolist(), mine, strict=True)], pa.list_(pa.int32()))})

        return batches

    index = unique.select("ids", "v", "dim").mapInArrow(routed(1, "ids"), "ids array<bigint>, v array<double>, dim int, to array<int>").select("ids", "v", "dim", F.get("to", F.lit(0)).alias("cell"))
    queries = rows.where(F.col("id") % every == 0).withColumn("dim", F.size("v"))
    queries = queries.select("id", "v", "dim").mapInArrow(routed(router.probes, "id"), "id bigint, v array<double>, dim int, to array<int>").select("id", "v", "dim", F.explode("to").alias("cell"))
    index, queries = settle(index, "index"), settle(queries, "queries")
    index, queries, block = vectors.in_blocks(index, queries, ["dim", "cell"])

    def best(_: tuple, mine: pa.Table, asked: pa.Table) -> pa.Table:
        ids, scores, places = [], [], []
        if mine.num_rows and asked.num_rows:
            x, least = vectors.matrix(mine, "v"), np.array([i[0] for i in mine["ids"].to_pylist()])
            by_id = np.argsort(least, kind="stable")
            x = x[by_id]
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                product = vectors.matrix(part, "v") @ x.T
                top = np.argsort(-product, axis=1, kind="stable")[:, : k + 1]
                ids.append(np.repeat(part["id"].to_numpy(), top.shape[1]))
                scores.append(np.take_along_axis(product, top, 1).ravel())
                places.append(by_id[top].ravel())
        at = np.concatenate([np.empty(0, np.int64), *places])
        return pa.table({"id": np.concatenate([np.empty(0, np.int64), *ids]), "score": np.concatenate([np.empty(0), *scores]), "ids": mine["ids"].take(pa.array(at))})

    found = queries.groupBy(*block).cogroup(index.groupBy(*block))
    return vectors.ranked(found.applyInArrow(lambda key, asked, mine: best(key, mine, asked), "id bigint, score double, ids array<bigint>"), k)
