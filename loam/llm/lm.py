"""Language-model scoring by a probabilistic suffix tree over tokens.

Texts are lower-cased in A-Z and cut into words `[^\\x20\\x09-\\x0D]+`; a text's tokens are its words and one end. The
tree's symbols are classes of tokens: the end, each word that occurs WORD_COUNT times by itself, and the rarer words
by what they end in (SIGNATURES classes). A token's probability is that of its class after the tokens before it, times
the token's share of its class: (c + 1/2) over the class' sum of that and 1/2 for all unseen words. With no context
this is the unigram base; what contexts tell (a language, a style, a phrase, an end) comes on top.

1. Texts are gathered in blocks of about BLOCK_BYTES, each a row; it keeps its distinct words once and its texts as
   numbers of those words. Blocks ask for what they need to know, and are answered: questions are dealt out by hash
   into ranges, one row for each block and range, as packed arrays; whoever has a range sums up what all blocks say and
   answers each in the order of its question. So what moves between machines is about a byte or two for each distinct
   thing in a block, and no key's rows meet one by one. Blocks themselves stay where they are: their tables are dealt
   into buckets by block, to which the answers go.
2. Words are asked for first: their counts in the whole corpus, which give the base, the classes and the shares.
3. The tree grows a level at a time: blocks ask for their distinct pairs of context and next class, and learn the counts
   of the pairs and, of each context, how many classes follow it and how far it diverges from the shorter context. A
   context needs least_context() occurrences, and counts where its next classes differ from the shorter context's by the
   divergence test (count times Kullback-Leibler divergence over DIVERGENCE nats for each class seen next).
   Distributions are smoothed towards the shorter context's by as many pseudo-counts as classes were seen next. How
   often a context occurs is the count of a pair a level before, so rarer ones are never asked for. Contexts of over
   `hot` occurrences are asked for in parts, by their next classes, so that none is too large for one task.
4. A context is made longer unless only one class follows it (no longer one can pass then, at DIVERGENCE 1 or more),
   or more than LOOKAHEAD contexts in succession failed the test. There is no greatest length.
5. A token is scored by its longest context that passes the test, while its block goes through the levels.

Words need a fixed count to be themselves (in a small corpus the share WORD_PREVALENCE). A context's least count grows as
the corpus to the power of two thirds, so contexts grow with the corpus, but slower: with a fixed count, ever more
tokens would have ever longer contexts, and what is asked for a token would grow without bound. Words are told apart exactly, contexts by 64-bit hashes.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm._common import drop, id_mod, prepare, settle, settle_dealt

BLOCK_BYTES = 8 << 20
CONTEXT_COUNT = 30
PREVALENCE = 3e-4
WORD_COUNT = 100
WORD_PREVALENCE = 1e-3
LOOKAHEAD = 2
SIGNATURES = 254
DIVERGENCE = 1.0
HELD_OUT = (5, 1)
#: Questions are dealt into RANGES at least, more where there is a range to every RANGE_TOKENS tokens.
RANGES, RANGE_TOKENS = 16, 2 << 20
#: Buckets that blocks are dealt into: two to a block, up to so many.
MOST_BUCKETS = 20_000
#: Classes: the end of a text, what stands before its first word, then signatures; other words after those.
END, BEGIN, FIRST = 0, 1, 2
OWN = FIRST + SIGNATURES

_FOLD = bytes(32 if x == 32 or 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Rows of every intermediate table: of which block (ranges' own: -1), which range, how many tokens go on, what kind, packed arrays.
_ROW = "block bigint, range bigint, alive bigint, body binary, kind string"
_ROW_TYPE = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("alive", pa.int64()), ("body", pa.binary()), ("kind", pa.string())])
_ZSTD = pa.Codec("zstd", 3)


def pack(**values: object) -> bytes:
    """Arrays and plain values as bytes: whole numbers in the fewest bytes, the planes of bytes together, compressed."""
    parts: dict[str, object] = {}
    for name, x in values.items():
        if isinstance(x, np.ndarray) and x.ndim == 1 and x.dtype != bool:
            if x.dtype.kind == "i" and len(x):  # unsigned ones are hashes
                x = x.astype(np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))
            parts[name] = (x.dtype.str, len(x), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
        elif isinstance(x, np.ndarray):
            parts[name] = ("bits", len(x), np.packbits(x).tobytes())
        else:
            parts[name] = x
    plain = pickle.dumps(parts, 5)
    return len(plain).to_bytes(8, "little") + _ZSTD.compress(plain, asbytes=True)


def unpack(body: bytes) -> dict:
    """pack() reversed; whole numbers come back as 64 bits."""
    out: dict[str, object] = {}
    for name, x in pickle.loads(_ZSTD.decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)).items():
        if isinstance(x, tuple) and x[0] == "bits":
            x = np.unpackbits(np.frombuffer(x[2], np.uint8), count=x[1]).astype(bool)
        elif isinstance(x, tuple):
            kind, n = np.dtype(x[0]), x[1]
            x = np.frombuffer(x[2], np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel() if n else np.empty(0, kind)
            if kind.kind in "iu" and kind.itemsize < 8:
                x = x.astype(np.int64)
        out[name] = x
    return out


def _by_frequency(numbers: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below `many` told by how frequent they are, which takes less room, and what those mean."""
    often = np.argsort(-np.bincount(numbers, minlength=many), kind="stable")
    rank = np.empty(many, np.int64)
    rank[often] = np.arange(many)
    return rank[numbers], often


def _rows(found: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ROW_TYPE.names, r, strict=True)) for r in found], _ROW_TYPE)


def _bodies(table: pa.Table, by: str) -> list[tuple[int, dict]]:
    """(block or range, unpacked body) of a table's rows, in order of that number."""
    return sorted(zip(table[by].to_pylist(), map(unpack, table["body"].to_pylist()), strict=True), key=lambda x: x[0])


def signature(word: bytes) -> int:
    """A class number for a word that isn't frequent: by its last two bytes before punctuation, and whether there is any."""
    bare = word.rstrip(b".,;:!?")
    return zlib.crc32(bare[-2:] + b"." * (bare != word)) % SIGNATURES


# words


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, all words in turn as numbers of those, and how many each text has."""
    joined = np.frombuffer(b" ".join(texts).translate(_FOLD), np.uint8)
    inside = joined != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    offsets = np.append(0, np.cumsum(end - begin))
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    coded = plain.dictionary_encode()
    stop = np.cumsum([len(x) + 1 for x in texts])
    lengths = np.diff(np.searchsorted(begin, stop), prepend=0)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), lengths


def _blocks(rows: DataFrame, ranges: int) -> DataFrame:
    """A row of kind `block` for each block of texts, and its questions for words; rows: doc_id, text binary, held."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[bool] = []
        texts: list[bytes] = []

        def block() -> list[pa.RecordBatch]:
            vocabulary, numbers, lengths = _numbered(texts)
            at = np.fromiter((zlib.crc32(w) % ranges for w in vocabulary), np.int64, len(vocabulary))
            order = np.argsort(at, kind="stable")  # words by range, and numbered so
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            out = np.array(held, bool)
            tokens = place[numbers]
            counts = np.bincount(tokens[~np.repeat(out, lengths)], minlength=len(vocabulary))
            learned = int(counts.sum())
            number = (task << 32) + made
            told, often = _by_frequency(tokens, len(vocabulary))
            body = pack(ids=np.array([x or 0 for x in ids], np.int64), no_id=np.array([x is None for x in ids], bool), held=out, lengths=lengths, tokens=told, often=often, learned=learned, texts=int((~out).sum()))
            found = [(number, -1, learned + int((~out).sum()), body, "block")]
            cuts = np.searchsorted(at[order], np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[r] : cuts[r + 1]]
                found.append((number, r, 0, pack(words=b" ".join([vocabulary[k] for k in mine.tolist()]), n=counts[cuts[r] : cuts[r + 1]]), "ask"))
            return _rows(found).to_batches()

        for batch in given:
            for doc_id, text, out in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("held").to_pylist(), strict=True):
                ids.append(doc_id)
                held.append(out)
                texts.append(text)
                size += len(text) + 64
                if size >= BLOCK_BYTES:
                    yield from block()
                    made, size, ids, held, texts = made + 1, 0, [], [], []
        if ids:
            yield from block()

    return rows.mapInArrow(batches, _ROW)


def _word_answers(ranges: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """Counts c and classes of the words asked for; a row of kind `sum` tells of the range: distinct words and the classes' mass."""

    def answer(asked: pa.Table) -> pa.Table:
        r, questions = asked["range"][0].as_py(), _bodies(asked, "block")
        total: Counter[bytes] = Counter()
        lists = [q["words"].split(b" ") for _, q in questions]
        for words, (_, q) in zip(lists, questions, strict=True):
            for word, n in zip(words, q["n"].tolist(), strict=True):
                total[word] += n
        mass, own, classes, kinds, frequent = np.zeros(OWN), 0.0, {}, 0, 0
        for word in sorted(total):
            c = total[word]
            kinds += c > 0
            if c >= least:
                classes[word] = OWN + frequent * ranges + r
                frequent, own = frequent + 1, own + c + 0.5
            else:
                classes[word] = FIRST + signature(word)
                mass[classes[word]] += (c + 0.5) * (c > 0)
        found = [(-1, r, 0, pack(kinds=kinds, mass=mass, own=own), "sum")]
        for words, (block, _) in zip(lists, questions, strict=True):
            c = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
            found.append((block, r, 0, pack(c=c, symbol=np.fromiter(map(classes.__getitem__, words), np.int64, len(words))), "answer"))
        return _rows(found)

    return answer


# contexts


@dataclass
class Tree:
    """States as rows: moves[state, class before] is the longer context's state or -1, chance[state, next class]."""

    moves: np.ndarray
    chance: np.ndarray

    def levels(self) -> np.ndarray:
        """The length of each state's context."""
        out = np.zeros(len(self.moves), int)
        now, depth = np.zeros(1, int), 0
        while len(now):
            out[now] = depth
            to = self.moves[now]
            now, depth = to[to >= 0], depth + 1
        return out

    def states(self, before: np.ndarray, depth: int) -> np.ndarray:
        """The state of the longest suffix for each row of `before`: the last class, the one before it, and so on (-1: none)."""
        state = np.zeros(len(before), np.int32)
        live = np.arange(len(before))
        for level in range(depth):
            symbol = before[live, level]
            to = np.where(symbol >= 0, self.moves[state[live], symbol], -1)
            live, to = live[to >= 0], to[to >= 0]
            state[live] = to
        return state


def _contexts(classes: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """For each token of texts laid end to end, the classes before it, the last first; BEGIN once, then -1."""
    place = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(classes), depth), -1, np.int32)
    for back in range(1, depth + 1):
        within = place >= back
        out[within, back - 1] = classes[np.flatnonzero(within) - back]
        out[place == back - 1, back - 1] = BEGIN
    return out


def least_context(tokens: int) -> float:
    """How often a context must occur in so many tokens: 30 times in 27 million, 300 times in 860 million."""
    return max(2.0, tokens ** (2 / 3) / 3000)


def least_count(count: int, share: float, tokens: int) -> float:
    """`count`, or in a small corpus the share of its tokens, two at least."""
    return max(2.0, min(count, share * tokens))


def _mixed(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a context made longer by a symbol."""
    x = state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """A block between two levels.

    score: of all its texts, what is decided so far. Of the texts not yet done: docs (which they are), lengths, held,
    classes (their tokens as places in symbols, ascending class numbers), live (tokens that have contexts of `level`
    classes), rare (tokens of which a context was too rare: every longer one is). Of each pair of context and next class
    that live tokens have (at level 1 of each symbol, for any context): lower (its chance after the shorter context, to
    15 bits, which is what moves between levels) and best (after the longest that passed, likewise). Of each context: lag (how many in succession failed) and bound (it occurs no more often). ranges: in which it asks.
    """

    level: int
    ranges: int
    score: np.ndarray
    docs: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    symbols: np.ndarray
    classes: np.ndarray
    live: np.ndarray
    rare: np.ndarray
    lower: np.ndarray
    best: np.ndarray
    lag: np.ndarray
    bound: np.ndarray

    def chances(self, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
        """lower and best of each pair."""
        return (self.lower[pairs.next], self.best[pairs.next]) if self.level == 1 else (self.lower, self.best)

    def packed(self) -> bytes:
        classes, often = _by_frequency(self.classes, len(self.symbols))
        unlike = self.best != self.lower
        return pack(**self.__dict__ | {"classes": classes, "best": self.best[unlike]}, often=often, unlike=unlike)

    @staticmethod
    def unpacked(body: bytes) -> Block:
        found = unpack(body)
        found["classes"] = found.pop("often")[found["classes"]]
        best = found["lower"].copy()
        best[found.pop("unlike")] = found["best"]
        return Block(**found | {"best": best})


def _short(chance: np.ndarray) -> np.ndarray:
    """Chances to 15 bits: 32-bit floats whose last byte is zero."""
    return ((chance.astype(np.float32).view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


@dataclass
class Pairs:
    """What a block's live tokens have: contexts by hash, pairs of context and next class, and each token's pair."""

    tokens: np.ndarray
    place: np.ndarray
    text: np.ndarray
    context: np.ndarray
    of: np.ndarray
    next: np.ndarray
    inverse: np.ndarray

    def first(self) -> np.ndarray:
        """A token of each pair (its place among the live)."""
        out = np.empty(len(self.of), np.int64)
        out[self.inverse[::-1]] = np.arange(len(self.inverse))[::-1]
        return out


def _pairs(lengths: np.ndarray, symbols: np.ndarray, classes: np.ndarray, live: np.ndarray, level: int) -> Pairs:
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    tokens = np.flatnonzero(live)
    place = tokens - start[tokens]
    text = np.repeat(np.arange(len(lengths)), lengths)[tokens]
    width = max(1, len(symbols))
    if level == 1:  # the class before is the context
        before = np.where(place >= 1, classes[np.maximum(tokens - 1, 0)], len(symbols))
        used = np.flatnonzero(np.bincount(before, minlength=len(symbols) + 1))
        known = _mixed(np.zeros(len(used), np.int64), np.append(symbols, BEGIN)[used])
        by_hash = np.argsort(known)
        rank = np.empty(len(symbols) + 1, np.int64)
        rank[used[by_hash]] = np.arange(len(used))
        context, of = known[by_hash], rank[before]
    else:
        state = np.zeros(len(tokens), np.uint64)
        for back in range(1, level + 1):
            state = _mixed(state, np.where(place >= back, symbols[classes[np.maximum(tokens - back, 0)]], BEGIN))
        context, of = np.unique(state, return_inverse=True)
    code, inverse = np.unique(of * width + classes[tokens], return_inverse=True)
    return Pairs(tokens, place, text, context, code // width, code % width, inverse)


@dataclass
class Cells:
    """How a block's pairs are asked for: contexts, or parts of hot ones, dealt into ranges and put in order there."""

    key: np.ndarray  # of each cell, in order of range and key
    context: np.ndarray  # which context it is of
    cuts: np.ndarray  # where each range's cells begin
    size: np.ndarray  # pairs of each cell
    order: np.ndarray  # the pairs in order of cells, then of next class
    cell: np.ndarray  # the cell of each pair


def _cells(block: Block, pairs: Pairs, hot: float) -> Cells:
    symbols, bound, ranges = block.symbols, block.bound, block.ranges
    parts = 1 + (bound // hot).astype(np.int64)
    base = np.cumsum(parts) - parts
    context = np.repeat(np.arange(len(parts)), parts)
    part = np.arange(len(context)) - base[context]
    key = _mixed(pairs.context[context], part)
    at = key % np.uint64(ranges)
    order = np.lexsort((key, at))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = _mixed(np.zeros(len(pairs.next), np.int64), symbols[pairs.next]) % parts[pairs.of].astype(np.uint64)
    cell = rank[base[pairs.of] + own.astype(np.int64)]
    cuts = np.searchsorted(at[order], np.arange(ranges + 1))
    return Cells(key[order], context[order], cuts, np.bincount(cell, minlength=len(key)), np.argsort(cell, kind="stable"), cell)


def _questions(number: int, block: Block, pairs: Pairs, hot: float) -> list[tuple]:
    """A row of kind `ask` for each range that the block has cells in."""
    if not len(pairs.tokens):
        return []
    cells = _cells(block, pairs, hot)
    n = np.bincount(pairs.inverse, weights=~block.held[pairs.text], minlength=len(pairs.of)).astype(np.int64)
    told = np.bincount(cells.cell, weights=n * np.log(block.chances(pairs)[0].astype(float)), minlength=len(cells.key))
    following, n = block.symbols[pairs.next][cells.order], n[cells.order]
    stop = np.append(0, np.cumsum(cells.size))
    out = []
    for r in np.flatnonzero(np.diff(cells.cuts)).tolist():
        a, b = cells.cuts[r], cells.cuts[r + 1]
        mine = slice(stop[a], stop[b])
        out.append((number, r, 0, pack(key=cells.key[a:b], size=cells.size[a:b], told=told[a:b], next=np.diff(following[mine], prepend=0), n=n[mine]), "ask"))
    return out


def _answers(asked: pa.Table) -> pa.Table:
    """Of each pair asked for its count n in all blocks; of each cell total, kinds (classes seen next) and told.

    told: the sum of n (log n - log lower) over the cell's pairs. Blocks are summed in the order of their numbers.
    """
    r, questions = asked["range"][0].as_py(), _bodies(asked, "block")
    sizes = [q["size"] for _, q in questions]
    keys, cell = np.unique(np.concatenate([q["key"] for _, q in questions]), return_inverse=True)
    lower = np.bincount(cell, weights=np.concatenate([q["told"] for _, q in questions]), minlength=len(keys))
    code = np.repeat(cell, np.concatenate(sizes)) << 32 | np.concatenate([np.cumsum(q["next"]) for _, q in questions])
    pair, inverse = np.unique(code, return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([q["n"] for _, q in questions]), minlength=len(pair)).astype(np.int64)
    of = pair >> 32
    total = np.bincount(of, weights=n, minlength=len(keys)).astype(np.int64)
    kinds = np.bincount(of, weights=n > 0, minlength=len(keys)).astype(np.int64)
    told = np.bincount(of, weights=n * np.log(np.maximum(n, 1)), minlength=len(keys)) - lower
    found, at, pairs_at = [], 0, 0
    for (block, q), size in zip(questions, sizes, strict=True):
        mine, own = cell[at : at + len(size)], inverse[pairs_at : pairs_at + len(q["next"])]
        at, pairs_at = at + len(size), pairs_at + len(q["next"])
        found.append((block, r, 0, pack(n=n[own], total=total[mine], kinds=kinds[mine], told=told[mine]), "answer"))
    return _rows(found)


def _passes(total: np.ndarray, kinds: np.ndarray, told: np.ndarray, least: float, divergence: float) -> np.ndarray:
    return (total >= least) & (told - total * np.log(np.maximum(total, 1)) > divergence * kinds)


def _begun(lengths: np.ndarray, held: np.ndarray, symbols: np.ndarray, classes: np.ndarray, chance: np.ndarray, count: np.ndarray, ranges: int) -> tuple[Block, Pairs]:
    """A block at level 1; chance and count: of each symbol, and the count of BEGIN last."""
    live, n = np.ones(len(classes), bool), len(lengths)
    pairs = _pairs(lengths, symbols, classes, live, 1)
    hashes = _mixed(np.zeros(len(symbols) + 1, np.int64), np.append(symbols, BEGIN))
    by_hash = np.argsort(hashes)
    bound = count[by_hash[np.searchsorted(hashes[by_hash], pairs.context)]]
    lower = _short(chance)
    return Block(1, ranges, np.zeros(n), np.arange(n), lengths, held, symbols, classes, live, ~live, lower, lower, np.zeros(len(pairs.context), np.int64), bound), pairs


def _advanced(block: Block, answers: list[tuple[int, dict]], least: float, divergence: float, lookahead: int, hot: float, ranges: int) -> tuple[Block, Pairs]:
    """The block at the next level, where it asks in `ranges`, by the answers to what it asked, and its pairs there. Texts that are done go."""
    pairs = _pairs(block.lengths, block.symbols, block.classes, block.live, block.level)
    if not len(pairs.tokens):
        return block, pairs
    cells = _cells(block, pairs, hot)
    n = np.empty(len(pairs.of), np.int64)
    n[cells.order] = np.concatenate([a["n"] for _, a in answers])
    total, kinds, told = (np.bincount(cells.context, weights=np.concatenate([a[k] for _, a in answers]), minlength=len(pairs.context)) for k in ("total", "kinds", "told"))
    passed = _passes(total, kinds, told, least, divergence)
    lower, best = block.chances(pairs)
    chance = _short((n + kinds[pairs.of] * lower) / np.maximum(total + kinds, 1)[pairs.of])
    best = np.where(passed[pairs.of], chance, best)
    lag = np.where(passed, 0, block.lag + 1)
    # which contexts go on, and where the one longer by a class is frequent enough: its count is that of the pair before
    frequent, opened = total >= least, (total >= least) & (kinds > 1) & (lag <= lookahead)
    of = pairs.of[pairs.inverse]
    go = opened[of] & (pairs.place >= block.level)
    rare, known = block.rare.copy(), np.full(len(block.classes), -1, np.int64)
    rare[pairs.tokens[~frequent[of]]] = True
    known[pairs.tokens] = n[pairs.inverse]
    before = np.maximum(pairs.tokens - 1, 0)
    too_rare = go & (block.rare[before] | (known[before] >= 0) & (known[before] < least))
    rare[pairs.tokens[too_rare]] = True
    go &= ~too_rare
    most = np.where(known[before] >= 0, known[before], total[of].astype(np.int64))
    score = block.score + np.bincount(block.docs[pairs.text[~go]], weights=np.log10(best.astype(float))[pairs.inverse[~go]], minlength=len(block.score))
    stay = np.zeros(len(block.lengths), bool)
    stay[pairs.text[go]] = True
    kept = np.repeat(stay, block.lengths)
    live = np.zeros(len(block.classes), bool)
    live[pairs.tokens[go]] = True
    out = Block(block.level + 1, ranges, score, block.docs[stay], block.lengths[stay], block.held[stay], block.symbols, block.classes[kept], live[kept], rare[kept], *[np.empty(0)] * 4)
    longer = _pairs(out.lengths, out.symbols, out.classes, out.live, out.level)
    first = longer.first()
    was = pairs.inverse[go][first]
    out.lower, out.best = chance[was], best[was]
    some = np.empty(len(longer.context), np.int64)  # a pair of each context
    some[longer.of[::-1]] = np.arange(len(longer.of))[::-1]
    out.lag, out.bound = lag[pairs.of[was[some]]], most[go][first[some]]
    return out, longer


def _state(number: int, block: Block, pairs: Pairs, hot: float) -> list[tuple]:
    return [(number, -1, len(pairs.tokens), block.packed(), "state"), *_questions(number, block, pairs, hot)]


def _of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind)


def _asked(rows: DataFrame, answer: Callable[[pa.Table], pa.Table], label: str) -> DataFrame:
    return settle(_of(rows, "ask").groupBy("range").applyInArrow(answer, _ROW), label, "kind")


def _ranges(tokens: int) -> int:
    """In how many ranges to ask about so many tokens."""
    return max(RANGES, tokens // RANGE_TOKENS)


def levels(rows: DataFrame, least: float, hot: float, buckets: int, divergence: float = DIVERGENCE, lookahead: int = LOOKAHEAD) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """The blocks with their questions, and the answers, level by level; last the blocks of which no token goes on.

    Tables of a level are deleted when the next one is written. One number for each level goes to the driver.
    """

    def advance(ranges: int) -> Callable:
        def go_on(_: tuple, state: pa.Table, given: pa.Table) -> pa.Table:
            number, answers = state["block"][0].as_py(), _bodies(given, "range")
            block = Block.unpacked(state["body"][0].as_py())
            return _rows(_state(number, *_advanced(block, answers, least, divergence, lookahead, hot, ranges), hot))

        return go_on

    while alive := _of(rows, "state").agg(F.sum("alive")).first()[0]:
        answers = _asked(rows, _answers, "answers")
        yield rows, answers
        longer = _of(rows, "state").groupBy("block").cogroup(_of(answers, "answer").groupBy("block"))
        new = settle_dealt(longer.applyInArrow(advance(_ranges(alive)), _ROW), "level", "kind", "block", buckets)
        drop(rows)
        drop(answers)
        rows = new
    yield rows, None


def grow(coded: DataFrame, mass: np.ndarray, tokens: int, depth: int = 3, prevalence: float = PREVALENCE, divergence: float = DIVERGENCE) -> Tree:
    """The contexts of up to `depth` classes that pass and those they extend, in memory: to look into small models. coded: classes, lengths, held."""
    width, root, least = len(mass), mass / mass.sum(), least_count(CONTEXT_COUNT, prevalence, tokens)

    def start(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for row in range(batch.num_rows):
                classes = np.frombuffer(batch.column("classes")[row].as_py(), "<i2").astype(np.int64)
                lengths, held = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in ("lengths", "held"))
                begun = _begun(lengths.astype(np.int64), held, np.arange(width), classes, root, np.full(width + 1, tokens), RANGES)
                yield from _rows(_state(batch.column("block")[row].as_py(), *begun, math.inf)).to_batches()

    numbered = coded.select("classes", "lengths", "held", F.monotonically_increasing_id().alias("block"))
    rows = settle_dealt(numbered.mapInArrow(start, _ROW), "level", "kind", "block", RANGES)
    known: dict[int, dict] = {}
    for level, (asked, answered) in enumerate(levels(rows, least, math.inf, RANGES, divergence)):
        if answered is None or level == depth:
            break
        said = {(r["block"], r["range"]): unpack(r["body"]) for r in _of(answered, "answer").collect()}
        for r in _of(asked, "ask").collect():
            question, a = unpack(r["body"]), said[r["block"], r["range"]]
            passed, following = _passes(a["total"], a["kinds"], a["told"], least, divergence), np.cumsum(question["next"])
            cell = np.repeat(np.arange(len(question["size"])), question["size"])
            for k in np.flatnonzero(a["total"] >= least).tolist():
                at = known.setdefault(int(question["key"][k]), {"n": np.zeros(width), "passed": bool(passed[k])})
                at["n"][following[cell == k]] = a["n"][cell == k]
    moves, chance = [], []

    def add(state: int, key: int | None, lower: np.ndarray) -> int:
        own = len(moves)
        moves.append(np.full(width, -1, np.int32))
        chance.append(lower)
        stays = key is None or known[key]["passed"]
        hashes = _mixed(np.full(width, state, np.uint64), np.arange(width))
        for symbol, (to, key_to) in enumerate(zip(hashes.tolist(), _mixed(hashes, np.zeros(width, np.int64)).tolist(), strict=True)):
            if key_to in known:
                n = known[key_to]["n"]
                kinds = (n > 0).sum()
                below = add(to, key_to, (n + kinds * lower) / (n.sum() + kinds))
                moves[own][symbol] = below
                stays |= below >= 0
        if not stays:
            del moves[own:], chance[own:]
            return -1
        return own

    add(0, None, root)
    return Tree(np.array(moves), np.array(chance))


def score_documents(documents: DataFrame, held_out: tuple[int, int] = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows whose crc32(doc_id as text) modulo held_out[0] is not held_out[1]. Null text counts as empty:
    one end. Repeated rows count again. With nothing to learn from, the base is 0. Ids are long or null.
    """
    spark = prepare(documents.sparkSession)
    held = id_mod(F.col(id_col), held_out[0]) == held_out[1]
    given = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), held.alias("held"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES, size // BLOCK_BYTES)
    buckets = min(MOST_BUCKETS, 2 * ranges)
    rows = settle_dealt(_blocks(given, ranges), "blocks", "kind", "block", buckets)

    def counted(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            bodies = [unpack(x.as_py()) for x in batch.column("body")]
            yield pa.RecordBatch.from_pydict({"learned": pa.array([x["learned"] for x in bodies], pa.int64()), "texts": pa.array([x["texts"] for x in bodies], pa.int64())})

    totals = _of(rows, "block").mapInArrow(counted, "learned bigint, texts bigint").agg(F.sum("learned").alias("n"), F.sum("texts").alias("texts")).first()
    texts = totals["texts"] or 0
    tokens = (totals["n"] or 0) + texts
    answers = _asked(rows, _word_answers(ranges, least_count(WORD_COUNT, WORD_PREVALENCE, tokens)), "words")

    def summed(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            bodies = [unpack(x.as_py()) for x in batch.column("body")]
            if bodies:
                mass = np.sum([x["mass"] for x in bodies], axis=0)
                yield pa.RecordBatch.from_pydict({"kinds": pa.array([sum(x["kinds"] for x in bodies)], pa.int64()), "own": pa.array([float(sum(x["own"] for x in bodies))], pa.float64()), "mass": pa.array([mass], pa.list_(pa.float64()))})

    sums = _of(answers, "sum").mapInArrow(summed, "kinds bigint, own double, mass array<double>")  # a few numbers a task, then one row for each class
    whole_sums = sums.agg(F.sum("kinds").alias("kinds"), F.sum("own").alias("own")).first()
    mass = np.full(OWN, 0.5)
    for r in sums.select(F.posexplode("mass").alias("class", "m")).groupBy("class").agg(F.sum("m").alias("m")).collect():
        mass[r["class"]] += r["m"]
    mass[END], mass[BEGIN] = texts + 0.5, 1e-9  # nothing is followed by a beginning
    whole = mass.sum() + (whole_sums["own"] or 0.0)
    floor = tokens + 0.5 * ((whole_sums["kinds"] or 0) + bool(texts) + 1)
    end_base = math.log10((texts + 0.5) / floor)
    hot = max(1.0, tokens / _ranges(tokens))

    def coded(_: tuple, block: pa.Table, given: pa.Table) -> pa.Table:
        number, found = block["block"][0].as_py(), [a for _, a in _bodies(given, "range")]
        s = unpack(block["body"][0].as_py())
        none = np.empty(0, np.int64)
        c, kind = (np.concatenate([none, *[a[k] for a in found]]) for k in ("c", "symbol"))
        symbols, local = np.unique(np.append(kind, END), return_inverse=True)
        weight = np.zeros(len(symbols))
        weight[local[:-1]] = c + 0.5
        shared = symbols < OWN
        weight[shared] = mass[symbols[shared]]
        base, inner = np.log10((c + 0.5) / floor), np.log10(c + 0.5) - np.log10(weight[local[:-1]])
        lengths, tokens_at = s["lengths"], s["often"][s["tokens"]]
        text = np.repeat(np.arange(len(lengths)), lengths)
        classes = np.full(len(tokens_at) + len(lengths), local[-1])
        classes[np.arange(len(tokens_at)) + text] = local[tokens_at]
        known, base, inner = (np.bincount(text, weights=x[tokens_at], minlength=len(lengths)) for x in (c > 0, base, inner))
        begun = _begun(lengths + 1, s["held"], symbols, classes, weight / whole, np.append(weight, texts).astype(np.int64), _ranges(tokens))
        about = pack(ids=s["ids"], no_id=s["no_id"], held=s["held"], sizes=lengths + 1, known=known.astype(np.int64) + (texts > 0), base=base + end_base, inner=inner)
        return _rows([(number, -1, 0, about, "about"), *_state(number, *begun, hot)])

    codes = settle_dealt(_of(rows, "block").groupBy("block").cogroup(_of(answers, "answer").groupBy("block")).applyInArrow(coded, _ROW), "coded", "kind", "block", buckets)
    drop(rows)
    drop(answers)
    about = settle(_of(codes, "about").select("block", "body"), "about")  # stays when the levels' tables go
    for state, _ in levels(codes, least_context(tokens), hot, buckets):
        pass
    done = settle(_of(state, "state").select("block", "body"), "scores")
    drop(state)

    def scored(_: tuple, told: pa.Table, done: pa.Table) -> pa.Table:
        a, s = unpack(told["body"][0].as_py()), unpack(done["body"][0].as_py())["score"]
        n = len(a["ids"])
        return pa.table({
            "doc_id": pa.array(a["ids"], pa.int64(), mask=a["no_id"]), "held_out": pa.array(a["held"], pa.bool_()), "n_tokens": pa.array(a["sizes"], pa.int64()), "n_known": pa.array(a["known"], pa.int64()),
            "train_tokens": pa.array(np.full(n, tokens), pa.int64()), "base_score": pa.array(a["base"], pa.float64()), "score": pa.array(s + a["inner"], pa.float64()),
        })

    out = about.groupBy("block").cogroup(done.groupBy("block"))
    return out.applyInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
