"""The text operators against brute force, on the test tables and on awkward rows."""

import hashlib
import math
import pickle
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from loam.llm import bpe, chat, langid, linededup, lm, mixing, quality, simhash
from loam.llm._common import table
from loam.llm.components import components
from loam.llm.queries import RANKS, oracle_sql

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as columns of the input.
CLASHING = ["fp", "node", "size", "taken", "h", "words", "row", "id", "lines", "ends", "k1", "score", "lang_pred", "text_", "block", "held", "source_"]
SPACE = " \t\n\r\x0b\x0c"

AWKWARD = [
    (1, "one two three four five. six\nseven", "en", "a"),
    (1, "one two three four five. six\nseven", "en", "a"),
    (2, "", "en", "a"),
    (3, None, "en", None),
    (4, "\n\n \t\n", None, None),
    (5, "one two", None, ""),
    (6, "a" * 3000 + " " * 500 + "-" * 700 + "\n" * 90, "en", "b"),
    (7, "Ünïcödé ẞ 漢字かな 🙂🙂  x y \x1c\x1d 12345678901234567890", "de", "b"),
    (8, "the same words again and again " * 2000, "en", "b"),
    (None, "no id at all here", "fr", "c"),
    (None, None, None, None),
    (9, "".join(random.Random(5).choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2500)), None, "c"),
]


def frame(spark, rows=AWKWARD, clashing=True):
    out = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(3)
    return out.withColumns({c: F.lit("clash") for c in CLASHING}) if clashing else out


def words(text, lower=True):
    out = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else " " if c in SPACE else c for c in text or "")
    return [w for w in out.split(" ") if w]


def crc(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def nulls(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if not isinstance(x, list) else (False, str(x)) for x in r))


@pytest.fixture(scope="module")
def encoding():
    engine = bpe.Engine(bpe.read_ranks(PATH), PATTERN)
    return engine, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=engine.ranks, special_tokens={})


def test_every_token_encodes_to_itself(encoding):
    engine, _ = encoding
    tokens = list(engine.ranks)
    assert all(ids == [engine.ranks[t]] and back == t for t, (ids, back) in zip(tokens, engine.contract(tokens), strict=True))


def test_long_pieces_as_short_ones(encoding, monkeypatch):
    engine, whole = encoding
    pieces = [w for w in set(words(AWKWARD[8][1] + " " + AWKWARD[7][1])) | {"aaaaa", "abababab" * 20, "banana" * 30}]
    expected = [whole._encode_single_piece(w.encode()) for w in pieces]
    assert [x for x, _ in engine.contract([w.encode() for w in pieces])] == expected
    monkeypatch.setattr(bpe, "LONG_BYTES", 0)
    assert [x for x, _ in engine.contract([w.encode() for w in pieces])] == expected


def engine_of(tokens):
    """An engine of all single bytes and further tokens by rank."""
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {k.encode(): v for k, v in tokens.items()}
    return bpe.Engine(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items()), PATTERN), ranks


@pytest.mark.parametrize("tokens", [{"xab": 256, "xaba": 257, "ab": 258}, {"cd": 65634, "acd": 70000, "ab": 300}, {"aa": 259, "aaa": 257, "aaaa": 256, "ab": 300, "aab": 258}])
def test_odd_vocabularies(monkeypatch, tokens):
    """Merges that make pairs of lower rank, and ranks beyond 16 bits, in short pieces and in long ones."""
    engine, ranks = engine_of(tokens)
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    pieces = ["".join(r.choice("xabcd"[: r.randint(2, 5)]) for _ in range(n)).encode() for n in [*range(1, 40), 70, 90, 200, 400]] + [b"bb", b"xabab", b"xabab" + b"q" * 70, b"a" * 150]
    expected = [whole._encode_single_piece(p) for p in pieces]
    assert [ids for ids, _ in engine.contract(pieces)] == expected
    monkeypatch.setattr(bpe, "LONG_BYTES", 0)
    assert engine.contract(pieces) == list(zip(expected, pieces, strict=True))


def test_vocabularies_refused():
    import base64

    with pytest.raises(ValueError, match="single bytes"):
        bpe.Engine(base64.b64encode(b"a") + b" 0", PATTERN)
    with pytest.raises(ValueError, match="ranks"):
        engine_of({"ab": 1 << 31})


def test_long_pieces_are_cut_where_no_token_reaches(encoding):
    engine, whole = encoding
    r = random.Random(9)
    piece = bytes(r.choice(b"\x00\x01\x1fqzQZ7") for _ in range(60_000))
    assert len(engine._apart(piece)) > 10_000
    assert engine.contract([piece]) == [(whole._encode_single_piece(piece), piece)]


def test_a_megabyte_without_a_break(encoding):
    engine, whole = encoding
    r = random.Random(11)
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"aaaeiorstn", b"="]
    piece = b"".join(bytes(r.choice(kinds[k % 3]) for _ in range(1000)) for k in range(1000))
    assert engine.contract([piece]) == [(whole._encode_single_piece(piece), piece)]


@pytest.mark.parametrize("window", [48, 16_384])
def test_windows_of_long_pieces(encoding, monkeypatch, window):
    """Windows of any width give what the whole piece gives, whatever stands at their ends."""
    engine, whole = encoding
    r = random.Random(window)
    pieces = ["".join(r.choice(kind) for _ in range(r.randint(65, 250))).encode() for kind in ("a", "ab", "the", "intos", "=-.", "\u00e8\u00e9\u4e2d", "AB01+/xyz") for _ in range(8)]
    monkeypatch.setattr(bpe, "WINDOW_BYTES", window)
    assert engine.prefixes is not None
    assert engine.contract(pieces) == [(whole._encode_single_piece(p), p) for p in pieces]


def test_random_vocabularies(monkeypatch):
    """Vocabularies of random merges, some with tokens that their own contraction misses: both ways of long pieces."""
    monkeypatch.setattr(bpe, "LONG_BYTES", 0)
    taken = Counter()
    for seed in range(40):
        r = random.Random(seed)
        letters, tokens = "abc"[: r.randint(1, 3)], {}
        pool = list(letters)
        for _ in range(r.randint(1, 12)):
            token = r.choice(pool) + r.choice(pool)
            if len(token) < 9 and token not in tokens:
                tokens[token] = 256 + len(tokens)
                pool.append(token)
        if seed % 2:  # tokens before the parts that they are made of
            tokens = dict(zip(r.sample(list(tokens), len(tokens)), tokens.values(), strict=True))
        engine, ranks = engine_of(tokens)
        whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        monkeypatch.setattr(bpe, "WINDOW_BYTES", r.choice([16, 64, 16_384]))
        pieces = ["".join(r.choice(letters) for _ in range(r.randint(1, 90))).encode() for _ in range(12)]
        assert engine.contract(pieces) == [(whole._encode_single_piece(p), p) for p in pieces]
        taken[engine.prefixes is None] += 1
    assert min(taken[True], taken[False]) > 5


@pytest.mark.parametrize("real", [False, True])
def test_bpe(spark, middle, encoding, real):
    docs = table(spark, middle, "documents") if real else frame(spark)
    rows = docs.select("doc_id", "text").collect()
    expected = []
    for doc_id, text in rows:
        ids = encoding[1].encode_ordinary(text or "")
        expected.append((doc_id, ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    encoded = bpe.encode_documents(docs, PATH, PATTERN)
    assert nulls(map(tuple, encoded.collect())) == nulls(expected)
    back = bpe.decode_documents(encoded, PATH, PATTERN).collect()
    assert Counter((r[0], bytes(r[1])) for r in back) == Counter((d, (t or "").encode()) for d, t in rows)


def test_bpe_empty_and_unknown(spark):
    assert bpe.encode_documents(frame(spark, []), PATH, PATTERN).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_documents(spark.createDataFrame([(1, [999999])], "doc_id bigint, ids array<int>"), PATH, PATTERN).collect()


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute_components(rows):
    prints = {t: brute_fingerprint(t) for t in {r[1] for r in rows}}
    low = {}
    for doc_id, text in rows:
        if doc_id is not None:
            low[prints[text]] = min(doc_id, low.get(prints[text], doc_id))
    order = sorted(low)
    same = classes(low.values(), [(low[a], low[b]) for i, a in enumerate(order) for b in order[i + 1 :] if (a ^ b).bit_count() <= 4])
    return [(d, f"{prints[t]:016x}", same[low[prints[t]]] if prints[t] in low else None) for d, t in rows]


@pytest.mark.parametrize("real", [False, True])
def test_simhash(spark, middle, real):
    docs = table(spark, middle, "documents") if real else frame(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert nulls(map(tuple, simhash.near_duplicates(docs).collect())) == nulls(brute_components(rows))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("chunk", "crowd"), [(2048, 64), (64, 64), (2048, 0)])
def test_links_in_crowds(spark, monkeypatch, chunk, crowd):
    """Clusters, chains and noise; small chunks deal a crowd out as pairs; no crowd allowed: eight blocks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for centre in [r.getrandbits(64) for _ in range(3)]:
        prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(250)}
    at = r.getrandbits(64)
    for _ in range(60):
        prints.add(at := at ^ sum(1 << b for b in r.sample(range(64), 4)))
    order = sorted(prints)
    expected = classes(range(len(order)), [(i, j) for i in range(len(order)) for j in range(i) if (order[i] ^ order[j]).bit_count() <= 4])
    nodes = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(order)], "node bigint, fp bigint")
    found = {n: c for n, c in components(simhash.links(nodes)).collect()}
    assert {n: found.get(n, n) for n in expected} == expected


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 2000 + k) for k in range(500)] + [(r.randrange(5000, 5300), r.randrange(5000, 5300)) for _ in range(200)] + [(7, 7), (9000, 9000)]
    expected = classes({x for e in edges for x in e if e[0] != e[1]}, edges[:-1])
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())) == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_targets(sizes, weights):
    budget, capped = 1.5 * sum(sizes), {}
    while True:
        rest, w = budget - sum(capped.values()), sum(x for k, x in enumerate(weights) if k not in capped)
        share = {k: rest * weights[k] / w for k in range(len(sizes)) if k not in capped}
        over = [k for k, v in share.items() if v > 2 * sizes[k]]
        if not over:
            return [capped.get(k, share.get(k)) for k in range(len(sizes))]
        capped |= {k: 2.0 * sizes[k] for k in over}


@pytest.mark.parametrize("real", [False, True])
def test_mixing(spark, middle, real):
    docs = table(spark, middle, "documents") if real else frame(spark)
    rows = docs.select("doc_id", "text", "source").collect()
    out = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, len(words(t))) for d, t, _ in rows)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words(t)) for _, t, x in rows if x == s) for s in names]
    aims = brute_targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert Counter((r["source_size"], round(r["target"], 6)) for r in out) == Counter((sizes[names.index(s)], round(aims[names.index(s)], 6)) for _, _, s in rows)
    of = dict(zip(zip([r[0] for r in rows], [r[1] for r in rows]), [r[2] for r in rows]))
    if real:
        source = {d: s for (d, _), s in of.items()}
        taken = defaultdict(int)
        for r in out:
            taken[source[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - a) <= 1 for s, a in zip(names, aims))


def test_mixing_ties_and_empty(spark):
    rows = [(7, "one two three four", "en", "a")] * 10 + [(8, "x " * 30, "en", "b")]
    out = mixing.mix(frame(spark, rows)).collect()
    tied = [r["taken"] for r in out if r["doc_id"] == 7]
    assert len(set(tied)) == 1
    assert abs(sum(tied) - next(r["target"] for r in out if r["doc_id"] == 7)) <= 10
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()] == [0, 0]


def test_mixing_awkward_as_in_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in AWKWARD])
    expected = Counter(con.execute(oracle_sql()["op6_mix_sources"]).fetchall())
    assert Counter(map(tuple, mixing.mix(frame(spark)).collect())) == expected


def test_mixed_documents(spark, middle):
    docs = table(spark, middle, "documents")
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    text = dict(map(tuple, docs.select("doc_id", "text").collect()))
    rows = mixing.mixed_documents(docs.withColumns({c: F.lit(1) for c in CLASHING}))
    assert rows.columns == [*docs.columns, *CLASHING]
    got = defaultdict(int)
    for doc_id, part in rows.select("doc_id", "text").collect():
        got[doc_id] += len(words(part))
        assert text[doc_id].startswith(part)
    assert got == {d: t for d, (_, t) in taken.items() if t}


def test_mixed_documents_without_ids(spark):
    """Rows that share an id, null too, are each taken as mix() says of them."""
    rows = [(d, f"{s}{n} " * (3 + 2 * n), "en", s) for d in (None, 7) for s in "ab" for n in range(4)]
    docs = frame(spark, rows)
    for weights in ((0.0, 1.0), (3.0, 1.0)):
        expected = sum(r["taken"] for r in mixing.mix(docs, weights).collect())
        got = mixing.mixed_documents(docs, weights=weights).select("text", "source").collect()
        assert sum(len(words(r["text"])) for r in got) == expected > 0
        assert {r["source"] for r in got} == ({"b"} if weights[0] == 0 else {"a", "b"})
        assert all(set(words(r["text"])) <= {f"{r['source']}{n}" for n in range(4)} for r in got)


def test_line_dedup_counts(spark):
    sites = [(100 + k, f"unique {k}\nshared by all\nshared by nine {'' if k < 9 else k}\n\nend {k}", "en", f"s{k}") for k in range(12)]
    sites += [(300, "shared by all\nshared by all", "en", None), (301, "shared by all", "en", "s0"), (301, "shared by all", "en", "s0")]
    sites += [(302, None, "en", "s1"), (303, "", "en", "s1"), (None, "shared by all\nx", "en", "s2")]
    out = linededup.dedup_lines(frame(spark, sites))
    assert out.select("row.*").columns == frame(spark, sites).columns
    got = {(r["doc_id"], r["text"], r["lines"], r["removed"]) for r in out.select("row.doc_id", "row.text", "lines", "removed").collect()}
    assert out.count() == len(sites)
    assert (None, "shared by all\nx", 2, 0) in got  # null ids come first
    assert (100, "unique 0\nshared by nine \n\nend 0", 5, 1) in got
    assert {(300, "", 2, 2), (301, "", 1, 1), (302, None, 0, 0), (303, "", 1, 0)} <= got
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_sketch_decides_far_and_counts_near(spark, middle):
    docs = table(spark, middle, "documents")
    rows = docs.select("doc_id", "text", "source").collect()
    spread, first = defaultdict(set), {}
    for doc_id, text, source in sorted(rows):
        for place, line in enumerate(text.split("\n")):
            if line.strip(SPACE):
                spread[line].add(source)
                first.setdefault(line, (doc_id, place))
    common = {line for line, s in spread.items() if len(s) >= 10}
    expected = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if x not in common or first[x] == (d, p)) for d, t, _ in rows}
    assert common
    assert dict(map(tuple, linededup.dedup_lines(docs).select("row.doc_id", "row.text").collect())) == expected


def test_suffix_automaton_phrases():
    own = langid.Parser({"xx": ["abcab cabd"], "yy": ["zzzz"]})

    def brute(text, sample):
        n, at = 0, 0
        while at < len(text):
            length = 1
            while at + length <= len(text) and text[at : at + length] in sample + " ":
                length += 1
            at += max(1, length - 1)
            n += 1
        return n

    for text in ["abcab", "abdcab", "zabcz", "dddd", "cab abc", "qab", "zzzzzzzzz"]:
        total, counts = own.phrases([text])
        assert total[0] == len(text)
        assert counts[0].tolist() == [brute(text, "abcab cabd"), brute(text, "zzzz")]


def test_language_id(spark, middle):
    docs = table(spark, middle, "documents")
    out = langid.predict_languages(docs).collect()
    lang = dict(map(tuple, docs.select("doc_id", "lang").collect()))
    assert len(out) == len(lang)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_language_id_awkward(spark):
    model = langid.fit(frame(spark))
    out = langid.identify(frame(spark), model, keep=True)
    got = Counter((r["doc_id"], r["lang_pred"] == "und") for r in out.collect())
    assert got[(2, True)] == got[(3, True)] == got[(4, True)] == 1
    assert got[(1, False)] == 2
    assert out.select("row.*").columns == frame(spark).columns
    assert langid.identify(frame(spark), langid.fit(frame(spark, []))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict_languages(frame(spark, [])).count() == 0


def test_quality(spark, middle):
    docs, labels = table(spark, middle, "documents"), table(spark, middle, "labels")
    out = {r["doc_id"]: r for r in quality.predict_quality(docs, labels).collect()}
    assert len(out) == docs.count()
    gold = dict(map(tuple, labels.select("doc_id", "quality").collect()))
    held = [out[d]["predicted"] == q for d, q in gold.items() if out[d]["held_out"]]
    assert sum(held) / len(held) > 0.95
    assert all(r["held_out"] == (crc(d, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in out.items())
    again = {r["doc_id"]: r["score"] for r in quality.predict_quality(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(abs(again[d] - r["score"]) < 1e-6 for d, r in out.items())


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1), (5, 0, 1), (6, 1, None), (3, 7, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.predict_quality(frame(spark), labels).count() == len(AWKWARD)
    assert {r["score"] for r in quality.predict_quality(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.predict_quality(frame(spark, []), labels).count() == 0


def test_repeats_of_a_row_do_not_change_what_is_learned(spark):
    good, bad = "A whole sentence of words. " * 3, "!!! ### 000 " * 5
    rows = [(k, good if k % 2 else bad, "en" if k % 2 else "de", "a") for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id bigint, quality int, toxic int")
    many = rows + rows[3:4] * 500
    assert pickle.loads(langid.fit(frame(spark, rows))) == pickle.loads(langid.fit(frame(spark, many)))
    once, again = (quality.fit(frame(spark, x, False), labels) for x in (rows, many))
    assert all((getattr(once, n) == getattr(again, n)).all() for n in ("edges", "weights", "moves"))
    assert once.bias == again.bias


def test_chain_against_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    counts, moves = np.array([1, 4, 2]), r.normal(size=(2, 2))
    emissions = r.normal(size=7)
    good, expected = quality._chain(emissions, counts, moves)
    at, brute, steps = 0, [], np.zeros((2, 2))
    for n in counts:
        weights = {y: math.exp(sum(emissions[at + k] * y[k] for k in range(n)) + sum(moves[y[k], y[k + 1]] for k in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        total = sum(weights.values())
        brute += [sum(w for y, w in weights.items() if y[k]) / total for k in range(n)]
        for y, w in weights.items():
            for k in range(n - 1):
                steps[y[k], y[k + 1]] += w / total
        at += n
    assert np.allclose(good, brute) and np.allclose(expected, steps)


def test_long_chains_in_runs(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    counts, moves = np.array([1, 700, 3, 1000, 257, 256, 40]), r.normal(size=(2, 2))
    emissions = r.normal(size=counts.sum())
    monkeypatch.setattr(quality, "RUN", 5000)
    good, expected = quality._chain(emissions, counts, moves)
    for run in (1, 2, 7, 256):
        monkeypatch.setattr(quality, "RUN", run)
        again, moved = quality._chain(emissions, counts, moves)
        assert np.allclose(good, again) and np.allclose(expected, moved)


def test_texts_of_very_many_lines():
    import time

    model = quality.Model(*[getattr(quality.train(*[x for x in (quality.line_features([b"a line of words\n" * 5, b"### 00\n" * 5])[k] for k in (0, 2))], __import__("numpy").array([1, 0])), n) for n in ("edges", "weights", "bias", "moves")])
    began = time.time()
    score = quality.score_texts(model, [b"a line of words\n" * 1_000_000, b"### 00\n" * 1000, b""])
    assert score[0] > 0.9 > 0.1 > score[1] and time.time() - began < 60
    assert len(set(quality.sampled_lines(100_000).tolist())) == quality.SAMPLE_LINES and quality.sampled_lines(100_000)[[0, -1]].tolist() == [0, 99_999]


def test_quality_scores_by_brute_force():
    """Features, bins, neighbours, chain and length weights, a line at a time."""
    import itertools

    texts = [b"One line here.\n\nAnother line, with more words in it!\n   x  x  x", b"", b"#!$ 99\n99 99 99", "Ünïcode Zeile.\n".encode()]
    features, _, counts = quality.line_features(texts)
    import numpy as np

    model = quality.train(features, counts, np.array([1, 0, 0, 1]))
    r = np.random.default_rng(3)
    model = quality.Model(model.edges, r.normal(size=model.weights.shape), 0.3, r.normal(size=(2, 2)))

    def look(line):
        kinds = [sum(b in group for b in line) for group in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"?()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~")]
        kinds = [len(line) - sum(kinds) - sum(b > 127 for b in line), *kinds, sum(b > 127 for b in line)]
        out = [k / len(line) if line else 0 for k in kinds] + [math.log1p(len(line))]
        w = line.split()
        tail = [len(line) / len(w), len(set(w)) / len(w), math.log1p(len(w)), w[-1][-1:] in (b".", b"?", b"!", b'"'), sum(a == b for a, b in zip(w, w[1:])) / len(w)] if w else [0] * 5
        return [int(np.searchsorted(model.edges[k], np.float32(x), "left")) for k, x in enumerate(out + tail)]

    for text, got in zip(texts, quality.score_texts(model, texts)):
        lines = text.split(b"\n")
        bins = [look(x) for x in lines]
        energy = []
        for k in range(len(lines)):
            e = 0.3 + sum(model.weights[0][f][x] for f, x in enumerate(bins[k]))
            e += sum(model.weights[1][f][x] for f, x in enumerate(bins[k - 1])) if k else 0
            e += sum(model.weights[2][f][x] for f, x in enumerate(bins[k + 1])) if k + 1 < len(lines) else 0
            energy.append(e)
        weigh = {y: math.exp(sum(e for e, v in zip(energy, y) if v) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(lines))}
        good = [sum(w for y, w in weigh.items() if y[k]) / sum(weigh.values()) for k in range(len(lines))]
        size = [len(x) for x in lines] if text.strip(b"\n") else [1] * len(lines)
        assert abs(got - sum(g * n for g, n in zip(good, size)) / sum(size)) < 1e-6


def test_languages_by_brute_force(monkeypatch):
    """The language of fewest phrases for each window, one phrase at a time."""
    monkeypatch.setattr(langid, "WINDOW", 7)
    r = random.Random(11)
    samples = {name: ["".join(r.choice(letters) for _ in range(60)) for _ in range(2)] for name, letters in (("xx", "abc "), ("yy", "bcd "), ("zz", "漢字bか "))}
    samples = {k: [langid.fold(t) for t in v] for k, v in samples.items()}
    own = langid.Parser(samples)
    texts = ["".join(r.choice("abcdé漢字か 7") for _ in range(r.randrange(1, 60))) for _ in range(60)]

    def phrases(window, language):
        have = " ".join(samples[language]) + " "
        at = n = 0
        while at < len(window):
            length = 1
            while at + length < len(window) and window[at : at + length + 1] in have:
                length += 1
            at, n = at + length, n + 1
        return n

    for text, (lang, score) in zip(texts, own.best(texts)):
        folded = langid.fold(text)
        if not folded:
            assert (lang, score) == ("und", 0.0)
            continue
        totals = [sum(phrases(folded[k : k + 7], name) for k in range(0, len(folded), 7)) for name in own.langs]
        first, second = sorted(totals)[:2]
        assert (lang, score) == (own.langs[totals.index(first)], 1 - first / second)


def test_samples_are_spread_over_whole_texts():
    text = "".join(chr(0x4E00 + k) for k in range(5000))
    got = langid.spread(text, 1100)
    assert len(got) <= 1100 and got[0] == text[0] and got[-1] == text[-1]
    assert langid.spread(text, 200)[0] == text[0] and langid.spread(text, 200)[-1] == text[-1] and langid.spread(text, 200).count(" ") == 3
    assert langid.spread(text, 50) == text[2475:2525][:50] and langid.spread("ab", 5) == "ab" and langid.spread("abc", 1) == "b"


@pytest.mark.parametrize("real", [False, True])
def test_lm_base_and_model(spark, small, real):
    docs = table(spark, small, "documents") if real else frame(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    counts = Counter()
    for d, t in rows:
        if crc(d, 5) != 1:
            counts.update([*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    out = lm.score_documents(docs).collect()
    expected = []
    for d, t in rows:
        tokens = [*words(t), "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        expected.append((d, crc(d, 5) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5)))
    assert nulls((*tuple(r)[:5], round(r["base_score"], 5)) for r in out) == nulls(expected)
    held = [r for r in out if r["held_out"]]
    assert all(r["score"] < 0 for r in out)
    if real:
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def coded(spark, texts, held):
    import numpy as np

    rows = [([k], [h], [len(t)], bytearray(np.array(t, "<i2").tobytes())) for k, (t, h) in enumerate(zip(texts, held))]
    return spark.createDataFrame(rows, "doc_ids array<bigint>, held array<boolean>, lengths array<int>, classes binary")


def test_tree(spark):
    """Counts, smoothing and the divergence test against plain recounting; every state is a distribution."""
    import numpy as np

    r = random.Random(2)
    texts = []
    for _ in range(60):
        t = [r.randrange(2, 6)]
        while len(t) < 40:
            t.append((t[-1] - 1) % 4 + 2 if r.random() < 0.8 else t[-2] if len(t) > 1 and r.random() < 0.7 else r.randrange(2, 6))
        texts.append([*t, 0])
    held = [k % 5 == 0 for k in range(60)]
    mass = np.array([48.5, 1e-9, 500.0, 480.0, 470.0, 460.0])
    tokens = sum(len(t) for t, h in zip(texts, held) if not h)
    tree = lm.grow(coded(spark, texts, held), mass, tokens, prevalence=0.004)
    assert np.allclose(tree.chance.sum(1), 1)
    assert tree.levels().max() >= 2
    seen = Counter()
    for t, h in zip(texts, held):
        if not h:
            full = [1, *t]
            for k in range(1, len(full)):
                for n in range(4):
                    if k - n >= 0:
                        seen[tuple(full[k - n : k]), full[k]] += 1

    def check(state, context, lower):
        if context:
            n = np.array([seen[context, s] for s in range(6)], float)
            assert n.sum() >= 0.004 * tokens
            lower = (n + (n > 0).sum() * lower) / (n.sum() + (n > 0).sum())
        assert np.allclose(tree.chance[state], lower)
        for symbol, to in enumerate(tree.moves[state]):
            if to >= 0:
                check(to, (symbol, *context), lower)

    check(0, (), mass / mass.sum())
    flat = lm.grow(coded(spark, texts, held), mass, tokens, prevalence=0.004, divergence=1e9)
    assert len(flat.moves) == 1
    before = lm._contexts(np.array([3, 4, 0, 5, 0]), np.array([3, 2]), 3)
    assert before.tolist() == [[1, -1, -1], [3, 1, -1], [4, 3, 1], [1, -1, -1], [5, 1, -1]]


def test_lm_contexts_grow_with_the_corpus(spark):
    """Words and contexts too rare for a share of all tokens, and what only the fourth class before tells."""
    ids = [k for k in range(3000) if crc(k, 5) != 1]
    rows = [(k, f"x{n % 2} aa bb cc y{n % 2}", "en", "a") for n, k in enumerate(ids[:300])]
    rows += [(k, "filler " * 2000, "en", "a") for k in ids[300:900]]
    own, other = [k for k in range(3000) if crc(k, 5) == 1][:2]
    rows += [(own, "x0 aa bb cc y0", "en", "a"), (other, "x0 aa bb cc y1", "en", "a")]
    score = {r["doc_id"]: r["score"] for r in lm.score_documents(frame(spark, rows)).where("held_out").collect()}
    assert score[own] > score[other] + 1


def test_lm_empty(spark):
    assert lm.score_documents(frame(spark, [])).count() == 0
    only_held = next(k for k in range(100) if crc(k, 5) == 1)
    row = lm.score_documents(frame(spark, [(only_held, "a b", "en", "a")])).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] < 0


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_chat(spark):
    odd = "a\\<turn>user\nb</turn>\n\\\\<\n\\n</tu\\rn>"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "last"), (2, 0, "user", "alone"), (3, 0, None, "x"), (3, None, "as<s>\n\\n", "y"), (3, 0, None, "x"), (None, 1, "assistant", "z")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"{k}🙂") for k in range(41)]
    convs = spark.createDataFrame(rows, CHAT).repartition(4).withColumns({"t": F.lit(1), "ends": F.lit(2), "formatted": F.lit("3")})
    got = {r["conv_id"]: r for r in chat.digest(chat.format_examples(chat.with_added(convs))).collect()}
    by = defaultdict(list)
    for c, n, role, text in [*rows, (-7, 0, "user", chat.ADDED_TEXT), (-7, 1, "assistant", chat.ADDED_TEXT)]:
        by[c].append((n is None, n or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.format_examples(convs).where("conv_id = 4").collect()
    assert sorted(r["turns"] for r in examples) == [*range(2, 41, 2), 41]
    for r in examples:
        turns = chat.read_turns(r["formatted"])
        assert [t for _, t in turns] == [f"{k}🙂" for k in range(r["turns"])]
        if r["turns"] < 41:
            assert chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) == turns[-1][1]
        else:
            assert r["loss_start"] is None
    assert chat.format_examples(convs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not a formatted"):
        chat.read_turns("<turn>user\nno end")
