"""Quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line's emission looks at its own features and those of the lines next to
it, each cut into bins; transitions tie neighbours together. Forward and backward passes give each line's probability
of being good, and a document's score is their mean, weighted by the lines' lengths in bytes (all lines alike if all
are empty; an empty or null text is one empty line).

Fitting takes a bounded sample: SAMPLE_ROWS labelled documents chosen by a hash of their ids (rows that repeat an id count
once), whose lines all carry the document's label. Of documents of over SAMPLE_LINES lines it takes as many, in runs of
SAMPLE_RUN that are spread evenly from the first line to the last. Scoring reads whole texts.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm._common import id_mod, prepare

SAMPLE_ROWS = 4000
SAMPLE_LINES = 300
#: Lines that are passed through in step, and of a long text's sample that stand together.
RUN, SAMPLE_RUN = 256, 30
BINS = 15
ROUNDS = 160
HELD_OUT = (5, 0)
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"?()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _CLASSES[list(_bytes)] = _kind
_CLASSES[128:] = 8
KINDS = 9
FEATURES = KINDS + 6


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, the lines' lengths, and the number of lines of each text."""
    split = [text.split(b"\n") for text in texts]
    counts = np.array([len(x) for x in split], np.int64)
    lines = [line for x in split for line in x]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    out = np.zeros((len(lines), FEATURES), np.float32)
    full = np.flatnonzero(lengths)
    if len(full):
        kinds = _CLASSES[np.frombuffer(b"".join(lines), np.uint8)]
        begin = (np.cumsum(lengths) - lengths)[full]
        for kind in range(KINDS):
            out[full, kind] = np.add.reduceat((kinds == kind).view(np.uint8), begin, dtype=np.int32) / lengths[full]
    out[:, KINDS] = np.log1p(lengths)
    for k in full.tolist():
        words = lines[k].split()
        if words:
            n = len(words)
            out[k, KINDS + 1] = lengths[k] / n
            out[k, KINDS + 2] = len(set(words)) / n
            out[k, KINDS + 3] = np.log1p(n)
            out[k, KINDS + 4] = words[-1][-1:] in (b".", b"?", b"!", b'"')
            out[k, KINDS + 5] = sum(map(operator.eq, words, words[1:])) / n
    return out, lengths, counts


@dataclass(frozen=True)
class Model:
    """Bin edges, a weight of each bin for the line itself, the one before and the one after, and the chain's weights."""

    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # 3 x features x BINS
    bias: float
    moves: np.ndarray  # 2 x 2, from and to; 1 is good

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], features[:, k], "left") for k in range(features.shape[1])], 1) if len(features) else np.zeros((0, len(self.edges)), int)


def _emissions(bins: np.ndarray, weights: np.ndarray, bias: float, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The log odds of each line being good, before the chain."""
    column = np.arange(bins.shape[1])
    out = weights[0][column, bins].sum(1) + bias
    before, after = weights[1][column, bins].sum(1), weights[2][column, bins].sum(1)
    out[~first] += before[:-1][~first[1:]]
    out[~last] += after[1:][~last[:-1]]
    return out


def _step(state: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log weights of (bad, good) in the last axis, a line later, before its emission."""
    return np.logaddexp(state[..., :1] + moves[0], state[..., 1:] + moves[1])


def _chain(emissions: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good, and the expected number of moves.

    Texts are cut into runs of RUN lines, and all runs are passed through in step. What a run makes of either state
    before it is found first; those go from run to run of a text, and tell every run what comes before and after it.
    """
    runs = -(-counts // RUN)
    text, nth = np.repeat(np.arange(len(counts)), runs), np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    begin, length = (np.cumsum(counts) - counts)[text] + nth * RUN, np.minimum(RUN, counts[text] - nth * RUN)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")  # runs of more than t lines
    emission = np.stack([np.zeros(len(emissions)), emissions], 1)
    start = np.full((len(text), 2), 0.0)  # the state at a run's last line before; of a text's first run there is none
    after = np.zeros((len(text), 2))  # what follows a run's last line, by its state
    if len(text) > len(counts):
        through = np.zeros((len(text), 2, 2))  # by the state before (alike in first runs)
        for t, many in enumerate(alive.tolist()):
            mine = order[:many]
            if t:
                through[mine] = _step(through[mine], moves)
            else:
                through[:] = np.where((nth > 0)[:, None, None], moves, 0.0)
            through[mine] += emission[begin[mine] + t][:, None]
        first = np.cumsum(runs) - runs
        for k in range(1, int(runs.max())):
            at = first[runs > k] + k
            before = through[at - 1, 0] if k == 1 else np.logaddexp(start[at - 1, :1] + through[at - 1, 0], start[at - 1, 1:] + through[at - 1, 1])
            start[at] = before
        for k in range(int(runs.max()) - 2, -1, -1):
            at = first[runs > k + 1] + k
            after[at] = np.logaddexp(*np.moveaxis(through[at + 1] + after[at + 1][:, None], 2, 0))
    forward, backward = np.zeros((len(emissions), 2)), np.zeros((len(emissions), 2))
    for t, many in enumerate(alive.tolist()):
        mine = order[:many]
        at = begin[mine] + t
        came = _step(forward[at - 1] if t else start[mine], moves)
        forward[at] = (came if t else np.where((nth[mine] > 0)[:, None], came, 0.0)) + emission[at]
    backward[begin + length - 1] = after
    ahead = emission.copy()  # emission and what follows, of the line after
    for t in range(len(alive) - 2, -1, -1):
        at = begin[order[: alive[t + 1]]] + t
        backward[at] = np.logaddexp(*((backward[at + 1] + emission[at + 1])[:, None, :] + moves).transpose(2, 0, 1))
    ahead += backward
    stop = np.cumsum(counts) - 1
    total = np.repeat(np.logaddexp(*forward[stop].T), counts)
    inner = np.ones(len(emissions), bool)
    inner[stop] = False
    at = np.flatnonzero(inner)
    expected = np.exp(forward[at][:, :, None] + moves + ahead[at + 1][:, None, :] - total[at][:, None, None]).sum(0)
    log_odds = (forward[:, 1] + backward[:, 1]) - (forward[:, 0] + backward[:, 0])
    return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500))), expected


def _ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = int(counts.sum())
    first, last = np.zeros(total, bool), np.zeros(total, bool)
    stop = np.cumsum(counts)
    first[stop - counts] = True
    last[stop - 1] = True
    return first, last


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """The field that makes the labels likeliest, by Adam on the whole sample. No rows, or one label: a constant."""
    shape = (FEATURES, BINS - 1)
    if len(set(labels.tolist())) < 2:
        bias = 0.0 if not len(labels) else 6.0 if labels[0] else -6.0
        return Model(np.zeros(shape), np.zeros((3, FEATURES, BINS)), bias, np.zeros((2, 2)))
    low, high, steps = features.min(0), features.max(0), np.arange(1, BINS // 2 + 1)
    by_rank = np.quantile(features, steps / (BINS // 2 + 1), axis=0)
    by_range = low + (high - low) * (steps / (BINS // 2 + 1))[:, None]
    edges = np.sort(np.concatenate([by_rank, by_range]), axis=0).T[:, : BINS - 1]  # half by rank, half by range
    model = Model(edges, np.zeros((3, FEATURES, BINS)), 0.0, np.zeros((2, 2)))
    bins, (first, last) = model.bins(features), _ends(counts)
    gold = np.repeat(labels, counts).astype(float)
    gold_moves = np.zeros((2, 2))
    for y in (0, 1):
        gold_moves[y, y] = (counts[labels == y] - 1).sum()
    size = 3 * FEATURES * BINS
    now, mean, square = np.zeros(size + 5), np.zeros(size + 5), np.zeros(size + 5)
    flat = np.arange(FEATURES) * BINS + bins
    for step in range(1, ROUNDS + 1):
        weights, moves = now[:size].reshape(3, FEATURES, BINS), now[size + 1 :].reshape(2, 2)
        good, expected = _chain(_emissions(bins, weights, now[size], first, last), counts, moves)
        error = gold - good
        slopes = []
        for rows, errors in ((flat, error), (flat[:-1][~first[1:]], error[~first]), (flat[1:][~last[:-1]], error[~last])):
            slopes.append(np.bincount(rows.ravel(), np.repeat(errors, FEATURES), FEATURES * BINS))
        slope = np.concatenate([*slopes, [error.sum()], (gold_moves - expected).ravel()]) / len(counts) - 1e-3 * now
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        now = now + 0.08 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(edges, now[:size].reshape(3, FEATURES, BINS), float(now[size]), now[size + 1 :].reshape(2, 2))


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """The score of each text, from 0 to 1."""
    if not texts:
        return np.zeros(0)
    features, lengths, counts = line_features(texts)
    good, _ = _chain(_emissions(model.bins(features), model.weights, model.bias, *_ends(counts)), counts, model.moves)
    begin = np.cumsum(counts) - counts
    empty = np.add.reduceat(lengths, begin) == 0
    weight = lengths + np.repeat(empty, counts)
    return np.clip(np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin), 0, 1)


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """Fits on documents (doc_id, text) with a label in labels (doc_id, quality 0 or 1); `learn` restricts doc_id."""
    prepare(documents.sparkSession)
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn))
    named = named.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = named.orderBy(F.xxhash64(F.lit("quality"), "doc_id")).limit(SAMPLE_ROWS)  # the documented bound of the fit
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            out: list[tuple] = []
            for doc_id, text, quality in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True):
                features = line_features([text])[0]
                out.append((doc_id, quality, features[sampled_lines(len(features))].tobytes()))
            ids, marks, features = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(marks, pa.int32()), "features": pa.array(features, pa.binary())})

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(batches, "doc_id bigint, quality int, features binary")
    found = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("features").alias("features"))
    found = sorted(found.collect(), key=lambda r: r["doc_id"])
    each = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in found]
    features = np.concatenate(each) if each else np.zeros((0, FEATURES), np.float32)
    return train(features, np.array([len(x) for x in each], np.int64), np.array([r["quality"] for r in found], np.int64))


def sampled_lines(count: int) -> np.ndarray:
    """Which lines of a text of so many the fit takes."""
    if count <= SAMPLE_LINES:
        return np.arange(count)
    begins = np.linspace(0, count - SAMPLE_RUN, SAMPLE_LINES // SAMPLE_RUN).astype(np.int64)
    return (begins[:, None] + np.arange(SAMPLE_RUN)).ravel()


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row; the text alone decides."""
    prepare(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            scores = score_texts(model, [x.as_py() for x in batch.column("text")])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def predict_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fifth are never read."""
    modulus, rest = HELD_OUT
    model = fit(documents, labels, id_mod(F.col("doc_id"), modulus) != rest)
    out = score_documents(documents, model)
    return out.select("doc_id", (id_mod(F.col("doc_id"), modulus) == rest).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
