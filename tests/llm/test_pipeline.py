"""Each stage of the pipeline on what the one before kept, against brute force."""

from collections import Counter, defaultdict

import pytest
import tiktoken
from pyspark.sql import functions as F
from test_texts import AWKWARD, DOCS, PATH, PATTERN, SPACE, brute_components, brute_targets, words

import corpus_pipeline
from loam.llm import bpe
from loam.llm._common import settle, table


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    odd = spark.createDataFrame([(None if r[0] is None else 100_000 + r[0], *r[1:], len(r[1] or "")) for r in AWKWARD], DOCS)
    frames = [settle(docs.unionByName(odd.select(*docs.columns)), "given")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(settle(stage(spark, frames[-1], "/root/testdata/sf0.001"), "stage"))
    return frames


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source", "lang").collect()]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "bpe_encode"]


def test_columns(stages):
    assert all(f.schema == stages[0].schema for f in stages[1:5])
    assert all(r["n_chars"] == len(r["text"]) for f in stages[2:5] for r in f.select("text", "n_chars").collect())


def test_language_id(stages):
    """Texts with a letter stay, as they are; the rest goes."""
    assert Counter(rows(stages[1])) == Counter(r for r in rows(stages[0]) if r[1] and any(c.isalpha() for c in r[1]))


def test_line_dedup(stages):
    given = sorted(rows(stages[1]), key=lambda r: (r[0] is not None, r[0] or 0))
    spread, first = defaultdict(set), {}
    for doc_id, text, source, _ in given:
        for place, line in enumerate(text.split("\n")):
            if line.strip(SPACE):
                spread[line].add(source)
                first.setdefault(line, (doc_id, place))
    common = {line for line, s in spread.items() if len(s) >= 10}
    expected = Counter((d, "\n".join(x for p, x in enumerate(t.split("\n")) if x not in common or first[x] == (d, p)), s, g) for d, t, s, g in given)
    assert Counter(rows(stages[2])) == expected


def test_near_dedup(stages):
    given = rows(stages[2])
    kept = {d for d, _, c in brute_components([(d, t) for d, t, _, _ in given]) if d is not None and d == c}
    got = rows(stages[3])
    assert Counter(r[0] for r in got if r[0] is not None) == Counter(kept)
    assert Counter(r for r in got if r[0] is None) == Counter(r for r in given if r[0] is None)
    assert set(got) <= set(given)


def test_near_dedup_of_a_repeated_id(spark):
    texts = ["one text of a few words", "quite another text, and longer than that", "a third one that says yet something else"]
    given = spark.createDataFrame([(1, t, "en", "a", len(t)) for t in texts], DOCS)
    first, again = (corpus_pipeline.near_dedup(spark, x, "").collect() for x in (given, given.orderBy(F.desc("text")).repartition(3)))
    assert len(first) == 1
    assert first == again


def test_mix(stages):
    given, got = rows(stages[3]), rows(stages[4])
    names = sorted({r[2] for r in given}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(t)) for _, t, s, _ in given if s == n) for n in names]
    aims = brute_targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])
    for name, aim in zip(names, aims):
        assert abs(sum(len(words(t)) for _, t, s, _ in got if s == name) - aim) <= 2
    texts = {r[0]: r[1] for r in given}
    assert all(texts[d].startswith(t) for d, t, _, _ in got if d is not None)
    assert max(Counter(d for d, _, _, _ in got if d is not None).values()) <= 2


def test_encode(stages):
    ranks = bpe.Engine(bpe.read_ranks(PATH), PATTERN).ranks
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((d, tuple(whole.encode_ordinary(t))) for d, t, _, _ in rows(stages[4]))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages[5].collect()) == expected


def test_run_is_the_stages(spark, small):
    docs = table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, small), "again")
    assert Counter(r["ids_sha256"] for r in corpus_pipeline.run(spark, small).collect()) == Counter(r["ids_sha256"] for r in docs.collect())


def test_empty(spark, stages):
    docs = stages[0].where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, ""), "empty")
        assert docs.count() == 0
