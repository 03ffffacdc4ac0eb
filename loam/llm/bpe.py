"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one engine per Python worker.

Each partition splits its texts into pieces, keeps the distinct pieces it has not met lately, and hands them to
DuckDB as token-position rows (piece, position, token), one row a byte at first. A recursive query joins each row
and its successor with the merge table and contracts the leftmost pair of the lowest rank of every piece, until no
piece has a pair left. An ordered aggregation then lists each piece's ids and the bytes that those ids stand for.

Pieces of over LONG_BYTES bytes are contracted in many places at once, by windows. Beside the token rows stand the spans: where the bytes of any token
of two bytes or more occur. A span is live while it covers two tokens or more whole. A live span over just two is a
pair, and it is contracted when no live span that ends with its first token or begins with its second one has a lower
rank (equal ranks: from the left, without overlap): then nothing can take either token away before its turn. Tokens
that no live span covers are final. Spans that cross the window's end only stand in the way; the next window begins
where the first token isn't final. Rounds are then as many as merges depend on one another, whatever the length.
That needs a vocabulary in which every token's own contraction ends in that token, by rising ranks. With any other
one, long pieces are cut between bytes that stand side by side in no token, and what is still long takes a third query
that contracts, in a round, the occurrences of the piece's lowest pair from the left without overlap, up to the first
whose token makes a pair of lower rank with a neighbour: that pair is next.
So the rule is the same for all lengths and any vocabulary: always the leftmost pair of the lowest rank. A vocabulary
must hold all single bytes; ranks may be any below 2^31.

Null texts count as empty; an empty text has no tokens. Rows are handled one by one, so repeated rows give repeated
results, and further input columns are not looked at. Memory is bounded by one Arrow batch and two caches of
CACHE_PIECES pieces; texts are never cut.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm._common import prepare

#: At most 64: positions of short pieces take six bits.
LONG_BYTES = 64
#: Bytes of texts whose new pieces go into one query.
GATHERED_BYTES = 4 << 20
#: Bytes of pieces per DuckDB query.
QUERY_BYTES = 400_000
CACHE_PIECES = 400_000
#: Bytes of a long piece that are contracted at a time; a query takes windows until it has as many.
WINDOW_BYTES = 16_384

#: Positions are numbered through: place >> 6 is the piece, place & 63 the position, so that one order serves all.
_SHORT = """
WITH RECURSIVE step(place, tok, live) AS (
  SELECT piece::BIGINT * 64 + pos, tok, true FROM seed
  UNION ALL (
    WITH pair AS (
      SELECT a.place, a.tok,
             CASE WHEN a.next_place >> 6 = a.place >> 6 THEN (m.merged::BIGINT << 12) | ((a.place & 63) << 6) | (a.next_place & 63) END AS rank
      FROM (SELECT place, tok, lead(tok) OVER w AS next_tok, lead(place) OVER w AS next_place
            FROM step WHERE live WINDOW w AS (ORDER BY place)) a
      LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 31) + a.next_tok),
    best AS (SELECT place >> 6 AS piece, min(rank) AS hit FROM pair GROUP BY 1)
    SELECT p.place, CASE WHEN (b.hit >> 6) & 63 = p.place & 63 THEN (b.hit >> 12)::INTEGER ELSE p.tok END, b.hit IS NOT NULL
    FROM pair p JOIN best b ON b.piece = p.place >> 6
    WHERE b.hit IS NULL OR b.hit & 63 <> p.place & 63))
SELECT (s.place >> 6)::INTEGER AS piece, list(s.tok ORDER BY s.place) AS ids, list(v.bytes ORDER BY s.place) AS parts
FROM step s JOIN vocabulary v ON v.tok = s.tok WHERE NOT s.live GROUP BY 1
"""
#: Kinds of rows: 0 tokens, 1 spans, 2 final tokens, 3 tokens that the next window decides. Spans that cross the window's end end at NULL.
_WINDOW = """
WITH RECURSIVE step(piece, s, e, tok, kind) AS (
  SELECT piece, s, e, tok, kind FROM seed
  UNION ALL (
    WITH tok AS (
      SELECT piece, s, e, tok, lead(e) OVER w AS next_e, row_number() OVER w AS nth FROM step WHERE kind = 0 WINDOW w AS (PARTITION BY piece ORDER BY s)),
    live AS (
      SELECT x.piece, x.s, x.e, x.tok AS rank, a.nth, coalesce(x.e = a.next_e, false) AS pair, coalesce(b.nth, 1 << 30) AS last
      FROM step x JOIN tok a ON a.piece = x.piece AND a.s = x.s LEFT JOIN tok b ON b.piece = x.piece AND b.e = x.e
      WHERE x.kind = 1 AND (x.e IS NULL OR b.nth > a.nth)),
    ending AS (SELECT piece, e, min(rank) AS rank FROM live WHERE NOT pair AND e IS NOT NULL GROUP BY ALL),
    starting AS (SELECT piece, s, min(rank) AS rank FROM live GROUP BY ALL),
    pair AS (
      SELECT p.piece, p.s, p.nth, p.rank,
             coalesce(x.rank > p.rank, true) AND coalesce(y.rank >= p.rank, true) AS clear,
             p.nth - row_number() OVER (PARTITION BY p.piece, p.rank ORDER BY p.nth) AS run,
             CASE WHEN lag(p.nth) OVER w = p.nth - 1 THEN lag(p.rank) OVER w END AS before
      FROM live p JOIN tok a ON a.piece = p.piece AND a.nth = p.nth
      LEFT JOIN ending x ON x.piece = p.piece AND x.e = a.e LEFT JOIN starting y ON y.piece = p.piece AND y.s = a.e
      WHERE p.pair WINDOW w AS (PARTITION BY p.piece ORDER BY p.nth)),
    even AS (
      SELECT piece, nth, rank, bool_and(clear AND coalesce(before >= rank, true)) OVER (PARTITION BY piece, rank, run ORDER BY nth) AS taken
      FROM (SELECT *, nth - min(nth) OVER (PARTITION BY piece, rank, run) AS place FROM pair) WHERE place % 2 = 0),
    taken AS (SELECT piece, nth, rank FROM even WHERE taken),
    going AS (SELECT DISTINCT piece FROM taken),
    reach AS (SELECT piece, nth, max(last) AS last FROM live GROUP BY ALL),
    covered AS (
      SELECT t.piece, t.s, t.e, t.tok, t.nth, t.next_e, coalesce(max(r.last) OVER (PARTITION BY t.piece ORDER BY t.nth) >= t.nth, false) AS covered
      FROM tok t LEFT JOIN reach r ON r.piece = t.piece AND r.nth = t.nth)
    SELECT c.piece, c.s, CASE WHEN h.nth IS NULL THEN c.e ELSE c.next_e END, coalesce(h.rank, c.tok),
           CASE WHEN NOT c.covered THEN 2 WHEN g.piece IS NULL THEN 3 ELSE 0 END
    FROM covered c LEFT JOIN taken h ON h.piece = c.piece AND h.nth = c.nth
    LEFT JOIN taken o ON o.piece = c.piece AND o.nth = c.nth - 1
    LEFT JOIN going g ON g.piece = c.piece
    WHERE o.nth IS NULL
    UNION ALL
    SELECT l.piece, l.s, l.e, l.rank, 1 FROM live l JOIN going g ON g.piece = l.piece))
SELECT piece, list(tok ORDER BY s) FILTER (kind = 2) AS ids, list(s ORDER BY s) FILTER (kind = 2) AS places,
       min(s) FILTER (kind = 3) AS undecided
FROM step WHERE kind >= 2 GROUP BY piece
"""
_LONG = """
WITH RECURSIVE step(piece, pos, tok, live) AS (
  SELECT piece, pos, tok, true FROM seed
  UNION ALL (
    WITH pair AS (
      SELECT a.*, m.merged
      FROM (SELECT piece, pos, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos, lead(tok, 2) OVER w AS after_tok,
              lag(tok) OVER w AS before_tok, row_number() OVER w AS nth
            FROM step WHERE live WINDOW w AS (PARTITION BY piece ORDER BY pos)) a
      LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 31) + a.next_tok),
    lowest AS (SELECT piece, min(merged) AS merged FROM pair WHERE merged IS NOT NULL GROUP BY piece),
    hit AS (
      SELECT p.piece, p.pos, p.next_pos, p.nth, p.merged, p.before_tok, p.after_tok,
             p.nth - row_number() OVER (PARTITION BY p.piece ORDER BY p.pos) AS run
      FROM pair p JOIN lowest l ON l.piece = p.piece AND l.merged = p.merged),
    chosen AS (
      SELECT *, coalesce(lag(nth) OVER (PARTITION BY piece ORDER BY pos) = nth - 2, false) AS follows
      FROM (SELECT *, nth - min(nth) OVER (PARTITION BY piece, run) AS place FROM hit) WHERE place % 2 = 0),
    lower AS (
      SELECT c.piece, min(c.pos) AS pos FROM chosen c
      LEFT JOIN merges x ON x.pair = ((CASE WHEN c.follows THEN c.merged ELSE c.before_tok END)::BIGINT << 31) + c.merged
      LEFT JOIN merges y ON y.pair = (c.merged::BIGINT << 31) + c.after_tok
      WHERE least(x.merged, y.merged) < c.merged GROUP BY c.piece),
    taken AS (
      SELECT c.piece, c.pos, c.next_pos, c.merged FROM chosen c LEFT JOIN lower f ON f.piece = c.piece WHERE f.pos IS NULL OR c.pos <= f.pos)
    SELECT p.piece, p.pos, coalesce(t.merged, p.tok), l.piece IS NOT NULL
    FROM pair p
    LEFT JOIN taken t ON t.piece = p.piece AND t.pos = p.pos
    LEFT JOIN taken u ON u.piece = p.piece AND u.next_pos = p.pos
    LEFT JOIN lowest l ON l.piece = p.piece
    WHERE u.piece IS NULL))
SELECT s.piece, list(s.tok ORDER BY s.pos) AS ids, list(v.bytes ORDER BY s.pos) AS parts
FROM step s JOIN vocabulary v ON v.tok = s.tok WHERE NOT s.live GROUP BY s.piece
"""


def read_ranks(path: str) -> bytes:
    """The rank file's content; a vocabulary is of fixed size, so it travels with the tasks."""
    with open(path, "rb") as file:
        return file.read()


class Engine:
    """A vocabulary in a DuckDB of its own, with caches of the pieces met lately."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        import duckdb
        import regex

        self.find, self.cached = regex.compile(pattern).findall, CACHE_PIECES
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
        if lacking := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks {len(lacking)} single bytes, {lacking[0]} for one")
        if not all(0 <= rank < 1 << 31 for rank in self.ranks.values()):
            raise ValueError("ranks are from 0 to 2^31 - 1")
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.together = bytearray(1 << 16)  # pairs of bytes that stand side by side in some token
        for token in self.ranks:
            for a, b in zip(token, token[1:]):
                self.together[a << 8 | b] = 1
        merges = [
            ((self.ranks[token[:cut]] << 31) + self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        ]
        pair, merged = zip(*merges, strict=True) if merges else ((), ())
        ints = pa.int32()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("m", pa.table({"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, ints)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"tok": pa.array(self.ranks.values(), ints), "bytes": pa.array(self.ranks.keys(), pa.binary())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        # of the pieces met lately, and of those before: ids as text, decoded bytes
        self.young: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    def contract(self, pieces: list[bytes]) -> list[tuple[list[int], bytes]]:
        """Each piece's ids, and the bytes that they decode to."""
        if max(map(len, pieces), default=0) <= LONG_BYTES or self.prefixes is not None:
            return self._contract(pieces)
        parts, owner = [], []
        for k, piece in enumerate(pieces):
            found = [piece] if len(piece) <= LONG_BYTES else self._apart(piece)
            parts += found
            owner += [k] * len(found)
        out: list = [([], b"")] * len(pieces)
        for k, (ids, decoded) in zip(owner, self._contract(parts), strict=True):
            out[k] = (out[k][0] + ids, out[k][1] + decoded) if out[k][0] else (ids, decoded)
        return out

    def _apart(self, piece: bytes) -> list[bytes]:
        """A piece cut where no token reaches across."""
        import numpy as np

        at = np.frombuffer(piece, np.uint8).astype(np.int64)
        cuts = (np.flatnonzero(np.frombuffer(self.together, np.uint8)[at[:-1] << 8 | at[1:]] == 0) + 1).tolist()
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    @functools.cached_property
    def plain(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @functools.cached_property
    def prefixes(self) -> set[bytes] | None:
        """All beginnings of tokens; None if some token's own contraction doesn't end in it by rising ranks."""
        for token, rank in self.ranks.items():
            parts, last = [token[i : i + 1] for i in range(len(token))], -1
            while len(parts) > 1:
                lowest, at = min((self.ranks.get(a + b, rank + 1), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
                if not last <= lowest <= rank or lowest == rank and len(parts) > 2:
                    return None
                parts[at : at + 2], last = [parts[at] + parts[at + 1]], lowest
        return {token[:k] for token in self.ranks for k in range(1, len(token) + 1)}

    def _spans(self, piece: bytes, start: int, end: int) -> tuple[list[int], list[int | None], list[int]]:
        """Where tokens of two bytes or more occur that begin in a window: start, end and rank; the end is None beyond the window."""
        starts, ends, found = [], [], []
        for s in range(start, end):
            e = s + 2
            while e <= len(piece) and (part := piece[s:e]) in self.prefixes:
                if (rank := self.ranks.get(part)) is not None:
                    starts.append(s)
                    ends.append(e if e <= end else None)
                    found.append(rank)
                e += 1
        return starts, ends, found

    def _by_windows(self, pieces: list[bytes], chosen: list[int], out: list) -> None:
        """Contracts long pieces, each from where its last window left off; a window that decides nothing is doubled."""
        import numpy as np

        at, wide = dict.fromkeys(chosen, 0), dict.fromkeys(chosen, WINDOW_BYTES)
        ids: dict[int, list[int]] = {i: [] for i in chosen}
        while at:
            seeds, total, ends = [], 0, {}
            for i, start in at.items():
                ends[i] = end = min(len(pieces[i]), start + wide[i])
                places = np.arange(start, end)
                single = np.array(self.single, np.int32)[np.frombuffer(pieces[i], np.uint8)[start:end]]
                seeds.append(pa.table({"s": places, "e": places + 1, "tok": single, "kind": np.zeros(end - start, np.int32)}))
                s, e, rank = self._spans(pieces[i], start, end)
                seeds.append(pa.table({"s": pa.array(s, pa.int64()), "e": pa.array(e, pa.int64()), "tok": pa.array(rank, pa.int32()), "kind": np.ones(len(s), np.int32)}))
                seeds[-2:] = [x.append_column("piece", pa.array(np.full(len(x), i, np.int32))) for x in seeds[-2:]]
                total += end - start
                if total >= WINDOW_BYTES:
                    break
            self.db.register("seed", pa.concat_tables(seeds))
            for i, found, places, undecided in self.db.execute(_WINDOW).fetchall():
                stop = ends[i] if undecided is None else undecided
                if stop == at[i]:
                    wide[i] *= 2
                    continue
                ids[i] += [tok for tok, place in zip(found, places, strict=True) if place < stop]
                at[i], wide[i] = stop, WINDOW_BYTES
                if stop == len(pieces[i]):
                    del at[i]
        for i in chosen:
            out[i] = (ids[i], b"".join(self.plain[x] for x in ids[i]))

    def _contract(self, pieces: list[bytes]) -> list[tuple[list[int], bytes]]:
        out: list = [([], b"")] * len(pieces)
        long = [i for i, x in enumerate(pieces) if len(x) > LONG_BYTES]
        if long and self.prefixes is not None:
            self._by_windows(pieces, long, out)
            long = []
        for query, chosen in ((_SHORT, [i for i, x in enumerate(pieces) if 0 < len(x) <= LONG_BYTES]), (_LONG, long)):
            start = 0
            while start < len(chosen):
                end, total = start, 0
                while end < len(chosen) and (end == start or total + len(pieces[chosen[end]]) <= QUERY_BYTES):
                    total += len(pieces[chosen[end]])
                    end += 1
                self._run(query, pieces, chosen[start:end], out)
                start = end
        return out

    def _run(self, query: str, pieces: list[bytes], chosen: list[int], out: list) -> None:
        import numpy as np

        lengths = np.fromiter((len(pieces[i]) for i in chosen), np.int64, len(chosen))
        joined = np.frombuffer(b"".join(pieces[i] for i in chosen), np.uint8)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register(
            "seed",
            pa.table({
                "piece": np.repeat(np.array(chosen, np.int32), lengths),
                "pos": (np.arange(len(joined)) - first).astype(np.int32),
                "tok": np.array(self.single, np.int32)[joined],
            }),
        )
        for piece, ids, parts in self.db.execute(query).fetchall():
            out[piece] = (ids, b"".join(parts))

    def known(self, pieces: set[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """Ids as text and decoded bytes of all the pieces; the caches keep those met lately."""
        if len(self.young[0]) > self.cached:
            self.old, self.young = self.young, ({}, {})
        ids, decoded = self.young
        new = []
        for piece in pieces.difference(ids):
            if (found := self.old[0].get(piece)) is not None:
                ids[piece], decoded[piece] = found, self.old[1][piece]
            else:
                new.append(piece)
        for piece, (found, plain) in zip(new, self.contract([x.encode() for x in new]), strict=True):
            ids[piece], decoded[piece] = ",".join(map(str, found)), plain
        return self.young

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and the bytes that they decode to."""
        split = [self.find(text) for text in texts]
        ids, decoded = self.known(set().union(*split)) if split else ({}, {})
        for pieces in split:
            if len(pieces) > 1:
                chosen = itemgetter(*pieces)
                yield ",".join(chosen(ids)), b"".join(chosen(decoded))
            else:
                yield (ids[pieces[0]], decoded[pieces[0]]) if pieces else ("", b"")

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by an ordered aggregation over token-position rows."""
        where = [i for i, ids in enumerate(rows) for _ in ids]
        self.db.register(
            "given",
            pa.table({
                "place": pa.array(where, pa.int32()),
                "pos": pa.array([k for ids in rows for k in range(len(ids))], pa.int32()),
                "tok": pa.array([x for ids in rows for x in ids], pa.int32()),
            }),
        )
        out = [b""] * len(rows)
        found = self.db.execute("SELECT place, count(*), list(v.bytes ORDER BY pos) FROM given g JOIN vocabulary v ON v.tok = g.tok GROUP BY place").fetchall()
        for place, _, parts in found:
            out[place] = b"".join(parts)
        if sum(n for _, n, _ in found) != len(where):
            raise ValueError("an id is not in the vocabulary")
        return out


_engines: dict[bytes, Engine] = {}


def engine(ranks_file: bytes, pattern: str) -> Engine:
    """The worker's engine for a vocabulary; made once a process."""
    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    if key not in _engines:
        _engines.clear()
        _engines[key] = Engine(ranks_file, pattern)
    return _engines[key]


def _gathered(given: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in given:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, cached: int = CACHE_PIECES, gathered: int = GATHERED_BYTES) -> DataFrame:
    """id, ids array<int> (if wanted), n_tokens, and SHA-256 of the ids as text and of the bytes they decode to.

    Null text: as empty. Empty text: no ids. One output row for each input row, whatever the id; equal texts of a batch
    are encoded once. `cached` pieces (twice
    that at most) and `gathered` bytes of text bound a worker's memory: less of either costs time, never results.
    """
    prepare(documents.sparkSession)
    ranks_file = read_ranks(ranks_path)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [rows.schema["doc_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(ranks_file, pattern)
        own.cached = cached
        for batch in _gathered(given, gathered):
            texts = batch.column("text").to_pylist()
            distinct, found = dict.fromkeys(texts), []  # copies of a text often follow one another
            for k, (text, (told, plain)) in enumerate(zip(distinct, own.encode(list(distinct)), strict=True)):
                distinct[text] = k
                count = told.count(",") + 1 if told else 0
                found.append(([int(x) for x in told.split(",")] if with_ids and told else [], count, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(plain).hexdigest()))
            each = [found[distinct[text]] for text in texts]
            ids, counts, digests, decoded = zip(*each, strict=True) if each else ((), (), (), ())
            columns = {"doc_id": batch.column("doc_id")} | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})
            yield pa.RecordBatch.from_pydict(columns | {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return rows.mapInArrow(batches, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded binary, for rows of ids. A null list counts as empty; an id outside the vocabulary is an error."""
    prepare(encoded.sparkSession)
    ranks_file = read_ranks(ranks_path)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(ranks_file, pattern)
        for batch in given:
            decoded = own.decode(batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(decoded, pa.binary())})

    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")
