"""SimHash near-duplicates, linked through pivot distance tables.

Fingerprint: texts are lower-cased in A-Z, cut into words `[^\\x20\\x09-\\x0D]+`, and every run of four words (fewer
words: the whole sequence) is hashed by XXH64 with seed 42; a bit is set if over half the hashes have it. No words
give zero. Null text counts as empty.

Links: fingerprints that differ in at most 4 bits. Equal fingerprints are one node. A table of distances to PIVOTS
reference fingerprints bounds every pair: |d(x, p) - d(y, p)| <= d(x, y), so a pair whose coordinates differ by more
than 4 anywhere is discarded unseen and only the others are compared bit by bit. A random pivot keeps about half of
all pairs, so a table alone would still visit the square of the corpus; therefore pairs are first confined to
buckets of fingerprints with equal bits in all but four of some blocks (pigeonhole: nothing is lost), where more
fingerprints get more blocks. Buckets over CHUNK fingerprints are dealt out as pairs of chunks to many tasks, and
each task returns a spanning forest, never all pairs.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm._common import prepare, settle
from loam.llm.components import components

WORDS = 4
BITS = 4
PIVOTS = 16
CHUNK = 2048
#: Buckets up to this size are compared by shifting, all buckets of a batch at once.
SMALL = 96
#: Fingerprints expected in a bucket, at most, before another block is added.
CROWD = 64

_FOLD = bytes(32 if x == 32 or 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x for x in range(256))
_REFERENCES = np.array([random.Random(f"pivot {k}").getrandbits(64) for k in range(PIVOTS)], np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    import xxhash

    split = text.translate(_FOLD).split()
    if not split:
        return 0
    flat = b" ".join(split)
    length = np.fromiter(map(len, split), np.int64, len(split))
    begin = np.cumsum(length + 1) - length - 1
    end = begin + length
    if len(split) > words:
        begin, end = begin[: len(split) - words + 1], end[words - 1 :]
    else:
        begin, end = begin[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], 42) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp long (the fingerprint's 64 bits, signed), one row for each input row."""
    prepare(documents.sparkSession)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64())})

    return rows.mapInArrow(batches, "doc_id bigint, fp bigint")


def block_masks(count: int, bits: int = BITS) -> list[int]:
    """Masks of the bits that two fingerprints must share in at least one case if they differ in `bits` or fewer."""
    blocks = bits + 1
    while blocks < 2 * bits and count > CROWD << (64 * (blocks - bits) // blocks):
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(single, blocks - bits)]


def _near(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of x and y within `bits`: first by the pivot tables, then by the bits themselves."""
    kept = np.ones((len(x), len(y)), bool)
    for k in range(tx.shape[1]):
        kept &= (tx[:, k, None] - ty[None, :, k] + np.uint8(bits)) <= 2 * bits
    i, j = np.nonzero(kept)
    true = np.bitwise_count(x[i] ^ y[j]) <= bits
    return i[true], j[true]


def _shifted(group: np.ndarray, fps: np.ndarray, coordinates: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within groups (sorted, of at most SMALL rows), all groups at once."""
    first, second = [], []
    for shift in range(1, SMALL):
        i = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(i):
            break
        for k in range(coordinates.shape[1]):
            i = i[(coordinates[i, k] - coordinates[i + shift, k] + np.uint8(bits)) <= 2 * bits]
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= bits]
        first.append(i)
        second.append(i + shift)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *first]), np.concatenate([empty, *second])


def _spread(fps: np.ndarray, coordinates: np.ndarray, bits: int) -> np.ndarray:
    """For each row of a large bucket a row of its component, by breadth-first search over what is not yet reached."""
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        seed, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:128], frontier[128:]
            reached = np.zeros(len(left), bool)
            reached[_near(fps[now], fps[left], coordinates[now], coordinates[left], bits)[1]] = True
            root[left[reached]] = seed
            frontier, left = np.concatenate([frontier, left[reached]]), left[~reached]
    return root


def _forest(group: np.ndarray, fps: np.ndarray, nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each group of equal `group` (sorted), what is linked there."""
    coordinates = np.bitwise_count(fps[:, None] ^ _REFERENCES[None, :])
    size = np.bincount(group)[group] if len(group) else group
    root = np.arange(len(fps))
    little = np.flatnonzero(size <= SMALL)
    if len(little) > 1:
        i, j = _shifted(group[little], fps[little], coordinates[little], bits)
        label, before = np.arange(len(little)), None
        while before is None or (before != label).any():
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
        root[little] = little[label]
    for g in np.unique(group[size > SMALL]):
        rows = np.flatnonzero(group == g)
        root[rows] = rows[_spread(fps[rows], coordinates[rows], bits)]
    child = np.flatnonzero(root != np.arange(len(fps)))
    return nodes[child], nodes[root[child]]


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges a, b that connect every two of nodes (node long, fp long; each fp once) within `bits`, directly or by others."""
    prepare(nodes.sparkSession)
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(nodes.count(), bits)]
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])
    dealt = nodes.select("node", "fp", F.explode(keys).alias("at")).select("node", "fp", "at.mask", "at.key")
    crowded = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    crowded = crowded.select(F.col("mask").alias("m"), F.col("key").alias("k"), F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    dealt = dealt.join(crowded, (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k")), "left")
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.select("node", "fp", "mask", "key", parts.alias("parts"), F.pmod(F.xxhash64(F.lit("part"), "fp"), parts).cast("int").alias("part"))
    dealt = dealt.select("node", "fp", "mask", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    at = ["mask", "key", "lo", "hi"]
    dealt = dealt.select("node", "fp", "mask", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    dealt = dealt.repartition(*at).sortWithinPartitions(*at).select("node", "fp", F.xxhash64(*at).alias("g1"), F.hash(*at).alias("g2"))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(rows: pa.Table) -> pa.RecordBatch:
            g1, g2 = rows["g1"].to_numpy(), rows["g2"].to_numpy()
            new = np.ones(len(g1), bool)
            new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
            a, b = _forest(np.cumsum(new) - 1, rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy(), bits)
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        count = 0
        for batch in given:
            held.append(batch)
            count += batch.num_rows
            if count >= 16 * CHUNK:
                rows = pa.Table.from_batches(held)
                last = (rows["g1"][-1].as_py(), rows["g2"][-1].as_py())
                same = (rows["g1"].to_numpy() == last[0]) & (rows["g2"].to_numpy() == last[1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield linked(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held:
            yield linked(pa.Table.from_batches(held))

    return dealt.mapInArrow(batches, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row for each input row.

    Empty and null texts have fingerprint zero and are linked like any other. A row whose doc_id is null links
    nothing: its component_id is that of its fingerprint's rows with ids, or null. Repeated rows repeat. Ids are longs
    and name documents: rows of one id are one document, so what is linked to any of their texts is linked to all.
    """
    prints = settle(fingerprints(documents, id_col, text_col, words), "fingerprints")
    nodes = settle(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    joined = components(links(nodes, bits))
    classes = nodes.join(joined.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left")
    classes = classes.select(F.col("fp").alias("f"), F.coalesce("component", "node").alias("component_id"))
    out = prints.join(classes, F.col("fp") == F.col("f"), "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
