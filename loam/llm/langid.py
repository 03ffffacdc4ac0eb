"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it into phrases, each the
longest run that stands somewhere in the language's text; the language that needs the fewest phrases for each symbol
wins. Texts are folded (lower case; what is no letter becomes one separator) and parsed in windows of WINDOW symbols,
many windows and all languages in step; a window's end ends a phrase in all languages alike.

Fitting takes a bounded sample: SAMPLE_ROWS labelled documents of each language, chosen by a hash of their ids, and
SAMPLE_SYMBOLS folded symbols of each language, at most the same number from every chosen document: of longer ones,
windows spread evenly from the first symbol to the last. Of rows that repeat an id the first by folded text is taken,
however many there are. All letters of the sample are told apart; letters that it lacks share one symbol. An automaton
takes some ten bytes for each of its moves, a megabyte a language at most, whatever the script.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm._common import id_mod, prepare

SAMPLE_ROWS = 120
SAMPLE_SYMBOLS = 24_000
#: Groups that a language's ids are dealt into when the sample is chosen.
PARTS = 16
WINDOW = 512
#: Symbols that a sample takes in a row, where it does not take all.
SPREAD = 64
UNKNOWN = "und"
HELD_OUT = (4, 2)


def fold(text: str) -> str:
    """Lower case, every run of other than letters as one space, none at the ends."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def spread(text: str, most: int) -> str:
    """At most `most` symbols of a text: all, or windows of about SPREAD symbols, evenly spaced over its length."""
    if len(text) <= most:
        return text
    windows = -(-most // SPREAD)
    width = (most + 1) // windows - 1
    last = len(text) - width
    return " ".join(text[last * (2 * k + 1) // 2 if windows == 1 else last * k // (windows - 1) :][:width] for k in range(windows))


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for symbol in symbols:
        now = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = now
            at = link[at]
        if at >= 0:
            to = moves[at][symbol]
            if longest[to] == longest[at] + 1:
                link[now] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                link[to] = link[now] = twin
                while at >= 0 and moves[at].get(symbol) == to:
                    moves[at][symbol] = twin
                    at = link[at]
        last = now
    return moves


def interleaved(moves: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """An automaton's moves as one array, its states' rows laid over each other, and the start's row by itself.

    A state is named by where its row begins, and no two begin alike; the cell at state + symbol holds, if it is the
    state's own, the state above 32 bits and the next state below.
    """
    size = sum(map(len, moves)) + len(moves) + 2 * symbols + 64
    taken, begun = bytearray(2 * size), bytearray(2 * size)
    begin = [0] * len(moves)
    first: dict[int, int] = {}  # by how many moves a row has: rows as long were found to fit from here on
    for state in sorted(range(len(moves)), key=lambda k: (-len(moves[k]), k)):
        row = list(moves[state])
        at = first.get(len(row), 0)
        while begun[at] or any(taken[at + x] for x in row):
            at += 1
            if at + symbols + 1 >= len(taken):
                taken.extend(bytes(len(taken)))
                begun.extend(bytes(len(begun)))
        first[len(row)] = at if len(row) < 3 else max(first.get(len(row), 0), at - 4 * symbols)
        begin[state], begun[at] = at, 1
        for x in row:
            taken[at + x] = 1
    cells = np.full(max(begin, default=0) + symbols + 1, -1, np.int64)
    for state, row in enumerate(moves):
        for symbol, to in row.items():
            cells[begin[state] + symbol] = begin[state] << 32 | begin[to]
    start = np.full(symbols, -1, np.int64)
    for symbol, to in moves[0].items():
        start[symbol] = begin[to]
    return cells, np.append(start, begin[0])


class Parser:
    """All languages' automata, and the parse of many windows in step."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        letters = sorted({c for texts in samples.values() for text in texts for c in text} - {" "})
        self.symbol = np.zeros(0x110000, np.int32)  # 0: separator, 1: a letter that no language's sample has
        self.symbol[[k for k in range(0x110000) if chr(k).isalpha()]] = 1
        self.symbol[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.tables = []
        for lang in self.langs:
            moves = automaton([int(x) for text in samples[lang] for x in [*self.symbol[[ord(c) for c in text]], 0]] if samples[lang] else [])
            self.tables.append(interleaved(moves, len(letters) + 2))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and phrases of each text in each language."""
        owner, parts = [], []
        total = np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            symbols = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
            if not symbols.any():
                continue
            letters[k] = True
            kept = np.ones(len(symbols), bool)
            kept[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
            symbols = symbols[kept]
            symbols = symbols[int(symbols[0] == 0) : len(symbols) - int(symbols[-1] == 0)]
            total[k] = len(symbols)
            for at in range(0, len(symbols), WINDOW):
                owner.append(k)
                parts.append(symbols[at : at + WINDOW])
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        if not parts or not self.langs:
            return total, counts
        order = np.argsort([-len(x) for x in parts], kind="stable")
        lengths = np.array([len(parts[k]) for k in order])
        grid = np.zeros((WINDOW, len(parts)), np.int64)
        for column, k in enumerate(order):
            grid[: len(parts[k]), column] = parts[k]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # windows of more than so many symbols
        owners = np.array(owner)[order]
        for lang, (cells, begins) in enumerate(self.tables):
            starts, root = begins[:-1], begins[-1]
            state = np.full(len(parts), root, np.int64)
            ended = np.zeros(len(parts), np.int64)
            for row, live in enumerate(alive.tolist()):
                now, symbol = state[:live], grid[row, :live]
                cell = cells.take(now + symbol)
                stuck = np.flatnonzero(cell >> 32 != now)
                if len(stuck):  # a phrase ends, and the symbol begins the next one; an unknown symbol is one by itself
                    again = starts.take(symbol[stuck])
                    ended[stuck] += 1 + ((again < 0) & (now[stuck] != root))
                    cell[stuck] = np.where(again < 0, root, again)
                state[:live] = cell & 0xFFFFFFFF
            counts[:, lang] = np.bincount(owners, weights=ended + (state != root), minlength=len(texts))
        return total, counts

    def best(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and a score of each text: 1 less the winner's phrases over the runner-up's."""
        out = []
        for text, total, counts in zip(texts, *self.phrases([x or "" for x in texts]), strict=True):
            if not total or text is None or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            order = np.argsort(counts, kind="stable")
            out.append((self.langs[order[0]], 1 - float(counts[order[0]] / counts[order[1]]) if len(order) > 1 else 1.0))
        return out


_parsers: dict[bytes, Parser] = {}


def parser(model: bytes) -> Parser:
    key = hashlib.sha256(model).digest()
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(pickle.loads(model))
    return _parsers[key]


def fit(documents: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """The folded sample of each language, from rows with a language and, if given, `learn`."""
    prepare(documents.sparkSession)
    lang, key = F.col(lang_col), F.xxhash64(F.lit("langid"), F.col(id_col))
    rows = documents.where(lang.isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.lit(True) if learn is None else learn))
    chosen = rows.select(lang.alias("lang_"), key.alias("key_")).distinct().withColumn("part_", F.spark_partition_id() % PARTS)
    for group in (["lang_", "part_"], ["lang_"]):  # a language of any size comes down to PARTS * SAMPLE_ROWS before it is one group
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("key_"))
        chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS)
    chosen = [r["key_"] for r in chosen.select("key_").collect()]  # at most SAMPLE_ROWS a language
    keyed = rows.select(lang.alias("lang_"), key.alias("key_"), F.col(text_col).alias("text_"))
    keys = documents.sparkSession.createDataFrame([(k,) for k in chosen], "key_ bigint")
    keyed = keyed.join(F.broadcast(keys.distinct()), "key_", "left_semi")

    def folded(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            texts = [spread(fold(x), 4 * SAMPLE_SYMBOLS) for x in batch.column("text_").to_pylist()]
            yield pa.RecordBatch.from_pydict({"lang_": batch.column("lang_"), "key_": batch.column("key_"), "text_": pa.array(texts, pa.string())})

    once = keyed.mapInArrow(folded, "lang_ string, key_ bigint, text_ string").groupBy("lang_", "key_").agg(F.min("text_").alias("text_"))
    by_lang: dict[str, dict[int, str]] = {}
    for r in once.collect():
        by_lang.setdefault(r["lang_"], {})[r["key_"]] = r["text_"]
    samples = {}
    for name, texts in sorted(by_lang.items()):
        ordered = [texts[k] for k in sorted(texts) if texts[k]]
        share, left = 0, SAMPLE_SYMBOLS
        for n, length in enumerate(sorted(map(len, ordered))):  # the most symbols a document can give so that all fit
            share = left // (len(ordered) - n)
            if length > share:
                break
            left -= length
            share = length
        samples[name] = [spread(x, share) for x in ordered if share]
    return pickle.dumps(samples)


def identify(documents: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for every row, and with `keep` the whole input row as the struct `row`.

    `und` and 0 if the text is null or has no letter. Ties go to the first language by code point. Without any
    labelled text all are `und`.
    """
    prepare(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if keep else []))
    row = f", row {rows.schema['row'].dataType.simpleString()}" if keep else ""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(model)
        for batch in given:
            found = own.best(batch.column("text").to_pylist())
            columns = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}
            yield pa.RecordBatch.from_pydict(columns | ({"row": batch.column("row")} if keep else {}))

    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double{row}")


def documents_in(documents: DataFrame, model: bytes, languages: set[str] | None = None) -> DataFrame:
    """The input rows whose predicted language is one of `languages` (None: any learned one)."""
    found = identify(documents, model, keep=True).where(F.col("lang_pred") != UNKNOWN)
    return (found if languages is None else found.where(F.col("lang_pred").isin(*languages))).select("row.*")


def predict_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from labelled rows outside the held-out quarter."""
    prepare(documents.sparkSession)
    modulus, rest = HELD_OUT
    model = fit(documents, id_mod(F.col("doc_id"), modulus) != rest)
    out = identify(documents, model)
    return out.select("doc_id", (id_mod(F.col("doc_id"), modulus) == rest).alias("held_out"), "lang_pred", "score")
