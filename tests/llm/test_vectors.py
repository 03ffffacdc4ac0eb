"""The vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import ann, topk, vectors
from loam.llm._common import table

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"
AWKWARD = [
    (0, [1.0, 0.0, 0.0], 1), (20, [0.0, 1.0, 0.0], 1), (40, [0.0, 0.0, 0.0], 1), (50, [1.0, 0.0, 0.0], 2), (100, [1.0, 0.0, 0.0], 2), (100, [1.0, 0.0, 0.0], 2),
    (60, None, 1), (80, [], 1), (120, [1.0, None, 0.0], 1), (140, [float("nan"), 0.0, 1.0], 1), (160, [float("inf"), 0.0, 1.0], 1),
    (180, [1.0, 2.0], 1), (181, [2.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (200, [-1.0, -0.5, 0.25], 1), *[(300 + k, [1.0, 0.0, 0.0], 3) for k in range(60)],
]


def brute(rows, every, k, integers):
    fine = [(i, [float(x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    fine = [(i, [float(np.floor(256 * x)) for x in v]) for i, v in fine] if integers else [(i, v) for i, v in fine if any(v)]
    out = set()
    for q, v in fine:
        if q % every == 0:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def clashing(spark, rows):
    out = spark.createDataFrame(rows, EMBEDDINGS).repartition(3)
    return out.withColumns({c: F.lit(1) for c in ("id", "v", "dim", "cell", "rank", "score", "ids", "h", "g")})


@pytest.mark.parametrize("block", [4096, 16])
def test_awkward(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "ROWS_BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES_BLOCK", block)
    df = clashing(spark, AWKWARD)
    got = {(r[0], r[1], r[2], float(r[3])) for r in topk.search(df).collect()}
    assert {g for g in got if g[0] != 100} == {b for b in brute(AWKWARD, 50, 5, True) if b[0] != 100}
    got = {(r[0], r[1], r[2], round(r[3], 9)) for r in ann.search(df, cells=2, recall=1.0).collect()}
    assert {g for g in got if g[0] != 100} == {(*b[:3], round(b[3], 9)) for b in brute(AWKWARD, 20, 20, False) if b[0] != 100}
    assert ann.search(clashing(spark, [])).count() == topk.search(clashing(spark, [])).count() == 0


@pytest.mark.parametrize("pivots", [None, 40])
def test_exact(spark, middle, pivots):
    df = table(spark, middle, "embeddings")
    got = {(r[0], r[1], r[2], float(r[3])) for r in topk.search(df, pivots=pivots).collect()}
    assert got == brute([tuple(r) for r in df.collect()], 50, 5, True)


def test_exact_stops_early_and_stays_exact():
    r = np.random.default_rng(0)
    centres = r.integers(-200, 200, size=(8, 6))
    x = (centres[r.integers(0, 8, 4000)] + r.integers(-3, 4, size=(4000, 6))).astype(float)
    most2 = float((x * x).sum(1).max())
    pivot = np.hstack([x[0], np.sqrt(most2 - x[0] @ x[0])])
    radius = np.sqrt(((topk._augmented(x, most2) - pivot) ** 2).sum(1))
    order = np.argsort(radius, kind="stable")
    x, radius = x[order], radius[order]
    for q in x[::500]:
        d = float(np.sqrt(((np.hstack([q, 0]) - pivot) ** 2).sum()))
        found = topk._expand(x, radius, np.arange(len(x)), q, d, float(q @ q) + most2, None, 6)
        assert found == sorted(((int(s), i) for i, s in enumerate(x @ q)), key=lambda p: (-p[0], p[1]))[:6]


def test_big_integers_are_exact():
    x, q = np.array([[3e9, 1.0], [3e9, 2.0]]), np.array([3e9 / 2, 1.0])
    assert topk._products(x, q).tolist() == [3 * 10**9 * 15 * 10**8 + 1, 3 * 10**9 * 15 * 10**8 + 2]


def test_recall(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = {(r[0], r[2]) for r in ann.search(df).collect()}
    want = {(b[0], b[2]) for b in brute([tuple(r) for r in df.collect()], 20, 20, False)}
    assert len(got & want) / len(want) >= 0.9
    assert len(got) == len(want)


def test_partitions_are_balanced():
    near = np.random.default_rng(1).integers(0, 1000, size=(1000, 6))
    sizes = np.bincount(ann.partition_graph(near, 8))
    assert len(sizes) == 8 and sizes.max() <= np.ceil(1.05 * 1000 / 8)


def test_routing_prunes_where_vectors_cluster():
    """Of clustered vectors most partitions aren't visited, and queries that took no part in the fit reach their nearest."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(48, 24))
    x = centres[r.integers(0, 48, 3000)] + 0.15 * r.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = ann.fit(x[:2000], 16)
    assert 1 <= router.probes <= 8
    cell, asked = router.order(x)[:, 0], router.order(x[2000:])[:, : router.probes]
    scores = x[2000:] @ x.T
    scores[np.arange(1000), np.arange(2000, 3000)] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : ann.K]
    assert (cell[near][:, :, None] == asked[:, None, :]).any(2).mean() >= 0.9
    assert (cell[None, :, None] == asked[:, None, :]).any(2).mean() <= 0.6


def test_annuli_prune_where_vectors_cluster(monkeypatch):
    """Far from the first annulus the triangle inequality leaves rows unread, and the result is exact."""
    r = np.random.default_rng(6)
    x = np.vstack([s * 100 + r.integers(-2, 3, size=(500, 5)) for s in range(1, 9)]).astype(float)
    most2 = float((x * x).sum(1).max())
    pivot = np.hstack([x[-1], np.sqrt(most2 - x[-1] @ x[-1])])
    radius = np.sqrt(((topk._augmented(x, most2) - pivot) ** 2).sum(1))
    order = np.argsort(radius, kind="stable")
    x, radius, read = x[order], radius[order], []
    plain = topk._products
    monkeypatch.setattr(topk, "_products", lambda rows, q: (read.append(len(rows)), plain(rows, q))[1])
    q = x[0]
    d = float(np.sqrt(((np.hstack([q, 0]) - pivot) ** 2).sum()))
    found = topk._expand(x, radius, np.arange(len(x)), q, d, float(q @ q) + most2, None, 6)
    assert found == sorted(((int(s), i) for i, s in enumerate(x @ q)), key=lambda p: (-p[0], p[1]))[:6]
    assert sum(read) < len(x)
