"""Byte-pair encoding of a corpus: training on the table of distinct words, encoding where the texts are read.

Training goes in phases. A phase looks at the most frequent pairs only and cuts the distinct words
into the stretches in which those stand; equal stretches are one, with the sum of their words' counts.
A bounded number of them holds all that is needed to merge, one by one, until the count falls to that
of the pairs left out: an index from pair to places keeps the counts by differences, so that a merge
touches the places of its pair. The merges of a phase are then applied to the words by tasks, which
count the pairs of the next one as they go. Tasks hold words in blocks, arrays of symbols' numbers.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import checkpointed

#: The special tokens, in the order of their ids.
SPECIALS = ("[BOS]", "[EOS]", "[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")
#: Fixed value: the public pattern of byte-level pre-tokens, each with the blank before it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the blanks of that pattern, which are Java's: one byte each in UTF-8.
BLANKS = list(b" \t\n\x0b\f\r")
#: Words whose pieces a task keeps, stretches that the driver takes for a phase and symbols to one of them on average.
MEMORY, STRETCHES, LONG = 200_000, 500_000, 8
#: Pairs that a phase looks at first and at most, symbols of a block of words.
FIRST_PAIRS, MOST_PAIRS, BLOCK = 64, 8192, 1 << 19
#: What training keeps between phases: blocks of words with their counts, and counts of pairs.
STATE = "symbols binary, weights binary, a string, b string, n long"


def byte_symbols() -> list[str]:
    """A visible character for each byte: printable Latin-1 ones stand for themselves, the others for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the printable characters of Latin-1
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def blank_words(text: Column) -> Column:
    """Pre-tokens without blanks, as they are."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _respelt() -> tuple[str, str]:
    """The characters of Latin-1 that byte_symbols replaces, and those that stand for them, in one order."""
    other = [(chr(b), c) for b, c in enumerate(byte_symbols()) if c != chr(b)]
    return "".join(x for x, _ in other), "".join(c for _, c in other)


def spelt(word: Column) -> Column:
    """A word with a character of byte_symbols for each byte; time in proportion to its length."""
    return F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), *_respelt())


def byte_words(text: Column, prefix_blank: bool = True) -> Column:
    """Byte-level pre-tokens: every byte is one character of byte_symbols, blanks too.

    With prefix_blank a text that begins with another character than a blank gets one before it, so
    that its first word is as those within; empty texts stay empty.
    """
    return F.transform(_pre_tokens(text, prefix_blank), spelt)


def _pre_tokens(text: Column, prefix_blank: bool = True) -> Column:
    return F.regexp_extract_all(led(text, prefix_blank), F.lit(PRE_TOKEN), F.lit(0))


def led(text: Column, prefix_blank: bool = True) -> Column:
    """The text with a blank before it, where it is not empty and begins with none."""
    return F.when((text != "") & ~F.startswith(text, F.lit(" ")), F.concat(F.lit(" "), text)).otherwise(text) if prefix_blank else text


def words(df: DataFrame, text: str, cut=blank_words) -> DataFrame:
    """Rows (word, n) of the pre-tokens of the whole corpus.

    A byte-level pre-token ends where a blank follows another character. So texts are cut there and the
    chunks counted; the pattern is applied once to each distinct one of a batch, spelling once to each
    distinct pre-token.
    """
    if cut is byte_words:
        chunks = df.select(led(F.col(text)).alias("text")).where("text is not null").mapInArrow(_counted_chunks, "chunk string, n long")
        raw = chunks.select(F.explode(_pre_tokens(F.col("chunk"), prefix_blank=False)).alias("raw"), "n").groupBy("raw").agg(F.sum("n").alias("n"))
        return raw.select(spelt(F.col("raw")).alias("word"), "n")
    w = df.select(F.explode(cut(F.col(text))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _counted_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of texts, blanks and what follows them up to the next, counted in each batch."""
    blank = np.zeros(256, bool)
    blank[BLANKS] = True
    for b in batches:
        texts = b.column(0).cast(pa.large_string())
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or starts[0] == starts[-1]:
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        border = np.zeros(len(data) + 1, bool)
        border[starts - starts[0]] = True
        blanks = blank[data]
        border[1:-1] |= blanks[1:] & ~blanks[:-1]
        ends = np.flatnonzero(border)
        chunks = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).value_counts()
        yield pa.RecordBatch.from_arrays([chunks.field(0).cast(pa.string()), chunks.field(1)], names=["chunk", "n"])


def merged(p: list[str], x: str, y: str) -> list[str]:
    """The symbols with each pair (x, y) merged, from left to right."""
    i, q = 0, []
    while i < len(p):
        if i + 1 < len(p) and p[i] == x and p[i + 1] == y:
            q.append(x + y)
            i += 2
        else:
            q.append(p[i])
            i += 1
    return q


def in_order(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The parts after the merges one after the other, by rank: one that is passed does not come back."""
    last = -1
    while len(parts) > 1:
        best = min((r for p in zip(parts, parts[1:], strict=False) if (r := ranks.get(p, -1)) > last), default=None)
        if best is None:
            break
        last = best
        x, y = next(p for p in zip(parts, parts[1:], strict=False) if ranks.get(p) == best)
        parts = merged(parts, x, y)
    return parts


def stretches(parts: list[str], pairs: Collection[tuple[str, str]], symbols: set[str]) -> Iterator[tuple[str, ...]]:
    """The stretches of a word in which these pairs stand, with the symbols beside them.

    Two neighbours stay together if they are one of the pairs, if they stand beside one, or if one of
    them is among `symbols`.
    """
    edges = [p in pairs for p in zip(parts, parts[1:], strict=False)]
    if not (True in edges or symbols):
        return
    start, n = 0, len(edges)
    beside = [False, *edges, False]
    for i in range(n + 1):
        if i == n or not (beside[i] or beside[i + 1] or beside[i + 2] or parts[i] in symbols or parts[i + 1] in symbols):
            if i > start:
                yield tuple(parts[start : i + 1])
            start = i + 1


class _Symbols:
    """Numbers of symbols: a character's is its code point plus one, a merged one's comes after all of those; 0 ends a word."""

    FIRST = 0x110001

    def __init__(self):
        self.texts: list[str] = []
        self.numbers: dict[str, int] = {}

    def number(self, text: str) -> int:
        if len(text) == 1:
            return ord(text) + 1
        if text not in self.numbers:
            self.numbers[text] = self.FIRST + len(self.texts)
            self.texts.append(text)
        return self.numbers[text]

    def text(self, number: int) -> str:
        return chr(number - 1) if number < self.FIRST else self.texts[number - self.FIRST]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, the distinct ones, and where each begins in that order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
    return order, ordered[starts], starts


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their n."""
    order, distinct, starts = _groups(keys)
    return distinct, np.add.reduceat(n[order], starts) if len(keys) else n


def _pair(x: int, y: int) -> int:
    return x << 32 | y


class _Edges:
    """Which neighbours in an array of symbols are one of these pairs of numbers."""

    def __init__(self, pairs: Collection[tuple[int, int]]):
        first, second = (sorted({p[k] for p in pairs}) for k in (0, 1))
        self.row, self.column = (np.zeros(max(side, default=0) + 2, np.int32) for side in (first, second))
        self.row[first], self.column[second] = np.arange(1, len(first) + 1), np.arange(1, len(second) + 1)
        self.table = np.zeros((len(first) + 1, len(second) + 1), bool)
        for x, y in pairs:
            self.table[self.row[x], self.column[y]] = True

    def among(self, symbols: np.ndarray) -> np.ndarray:
        row, column = self.row[np.minimum(symbols[:-1], len(self.row) - 1)], self.column[np.minimum(symbols[1:], len(self.column) - 1)]
        return self.table[row, column]


class _Places:
    """Words in one array of symbols, a 0 after each, linked to the neighbours that are left; where pairs stand.

    Without `edges` all pairs are looked at, else those.
    """

    def __init__(self, symbols: np.ndarray, edges: _Edges | None = None, wanted: Collection[int] | None = None):
        self.symbol, self.wanted = symbols.astype(np.int64), wanted
        self.after = np.minimum(np.arange(1, len(symbols) + 1), len(symbols) - 1)
        self.before = np.arange(-1, len(symbols) - 1)  # before the first one stands the last, a 0
        self.marked = np.zeros(len(symbols), bool)
        self.where: dict[int, list[np.ndarray]] = defaultdict(list)
        self.first = self._real(np.arange(len(symbols) - 1)) if edges is None else np.flatnonzero(edges.among(symbols))
        self._file(self.first)

    def pairs(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at] << 32 | self.symbol[self.after[at]]

    def _real(self, at: np.ndarray) -> np.ndarray:
        return at[(self.symbol[at] > 0) & (self.symbol[self.after[at]] > 0)]

    def _file(self, at: np.ndarray) -> None:
        order, distinct, starts = _groups(self.pairs(at))
        at, ends = at[order], [*starts[1:].tolist(), len(at)][: len(starts)]
        for p, start, end in zip(distinct.tolist(), starts.tolist(), ends, strict=True):
            if self.wanted is None or p in self.wanted:
                self.where[p].append(at[start:end])

    def _but(self, places: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The places, and those of the others that are not among them."""
        self.marked[places] = True
        out = np.concatenate([places, others[~self.marked[others]]])
        self.marked[places] = False
        return out

    def merge(self, x: int, y: int, z: int, changed: Callable[[np.ndarray, int], None] | None = None) -> None:
        """Each pair (x, y) becomes z, from left to right; `changed` is told the places of pairs that go (-1) and come (1)."""
        found = self.where.pop(_pair(x, y), None)
        if not found:
            return
        at = np.concatenate(found)
        at = at[(self.symbol[at] == x) & (self.symbol[self.after[at]] == y)]
        if x == y:
            at = np.sort(at)
            n, begins = np.arange(len(at)), np.ones(len(at), bool)
            begins[1:] = self.after[at[:-1]] != at[1:]
            at = at[(n - np.maximum.accumulate(np.where(begins, n, 0))) % 2 == 0]
        second = self.after[at]
        if changed:
            changed(self._real(np.concatenate([at, self._but(second, self.before[at])])), -1)
        third = self.after[second]
        self.symbol[at], self.symbol[second] = z, -1  # the second is gone
        self.after[at], self.before[third] = third, at
        new = self._real(self._but(at, self.before[at]))
        if changed:
            changed(new, 1)
        self._file(new)

    def kept(self) -> np.ndarray:
        """What is left, a 0 after each word."""
        return self.symbol[self.symbol >= 0].astype(np.int32)


class _Index:
    """Counts of the pairs of weighted stretches, kept by differences."""

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, names: _Symbols, floor: int):
        self.names, self.floor = names, floor
        self.weight = weights[np.cumsum(symbols == 0) - (symbols == 0)]
        self.places = _Places(symbols)
        self.count: dict[int, int] = defaultdict(int)
        self.heap: list[tuple[int, str, str]] = []
        self._add(self.places.pairs(self.places.first), self.weight[self.places.first])

    def _add(self, pairs: np.ndarray, n: np.ndarray) -> None:
        for p, d in zip(*(v.tolist() for v in _sums(pairs, n)), strict=True):
            if d:
                self.count[p] += d
                self._offer(p)

    def _offer(self, p: int) -> None:
        if self.count[p] > 0 and self.count[p] >= self.floor:
            heapq.heappush(self.heap, (-self.count[p], self.names.text(p >> 32), self.names.text(p & 0xFFFFFFFF)))

    def best(self) -> tuple[int, str, str] | None:
        """Count and symbols of the most frequent pair, on ties the first by text; of those of floor and more."""
        while self.heap:
            n, x, y = self.heap[0]
            if self.count[_pair(self.names.number(x), self.names.number(y))] == -n:
                return -n, x, y
            heapq.heappop(self.heap)
        return None

    def merge(self, x: str, y: str) -> None:
        pairs, weights = [], []

        def changed(at: np.ndarray, sign: int) -> None:
            pairs.append(self.places.pairs(at))
            weights.append(sign * self.weight[at])

        self.places.merge(self.names.number(x), self.names.number(y), self.names.number(x + y), changed)
        if pairs:
            self._add(np.concatenate(pairs), np.concatenate(weights))


def _phase(rows: list[tuple[list[str], int]] | tuple[np.ndarray, np.ndarray], pairs: dict[tuple[str, str], int], floor: int, symbols: set[str], most: int, least: int, names: _Symbols | None = None, beside: bool = True) -> list[tuple[str, str]]:
    """The merges that are certain from the stretches of `pairs`; those left out have counts of `floor` at most
    and come after the pairs of that count.

    With `beside` the stretches have the neighbours of the pairs. A merge of one of `pairs` shows all that it
    makes, as its neighbours are there. One of a pair that the phase has made itself may make pairs that were
    cut off. Such a new pair has a count of floor at most: so from then on nothing with that count is sure. A
    symbol that is there already, made anew in another way, is sure if both ways show all.

    Without `beside` the stretches end with the pairs, and `pairs` are all those above `floor`. A symbol is made
    in one way, so a pair of symbols always stands where one pair of the beginning stood: if that was left out,
    its count is floor at most, else all of it is in the stretches. So what is above floor is sure, until a
    symbol that is there already is made anew: that merge is the last.
    """
    names = names or _Symbols()
    if isinstance(rows, list):
        flat = [i for p, _ in rows for i in (*map(names.number, p), 0)]
        rows = np.array(flat or [0], dtype=np.int64), np.array([n for _, n in rows] or [0], dtype=np.int64)
    index, done, deep, made = _Index(*rows, names, max(1, least, floor if beside else floor + 1)), [], False, {}
    while len(done) < most:
        best = index.best()
        if best is None:
            break
        n, x, y = best
        shown = (x, y) in pairs
        again = x + y in symbols or x + y in made
        if (x, y) in done or (n == floor and (deep or pairs.get((x, y)) != n)) or (beside and again and not (shown and made.get(x + y, True))):
            break
        index.merge(x, y)
        done.append((x, y))
        made[x + y] = made.get(x + y, True) and shown
        deep |= not shown
        if again and not beside:
            break
    return done


def _ended(symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of these sizes with a 0 after each."""
    out = np.zeros(len(symbols) + len(size), np.int32)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(size)), size)] = symbols
    return out


def _long(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of two symbols and more."""
    size = np.diff(np.flatnonzero(symbols == 0), prepend=-1)
    keep = size > 2
    return symbols[np.repeat(keep, size)], weights[keep]


def _numbered(words: Sequence[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as a block: the numbers of their characters, a 0 after each word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return _ended(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) + 1, size), weights


def _blocks_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (word, n) as blocks of about BLOCK symbols."""
    words, weights, size = [], [], 0
    for b in batches:
        words += b.column(0).to_pylist()
        weights.append(b.column(1).to_numpy())
        size += pc.sum(pc.utf8_length(b.column(0))).as_py() or 0
        if size >= BLOCK:
            yield _numbered(words, np.concatenate(weights))
            words, weights, size = [], [], 0
    if words:
        yield _numbered(words, np.concatenate(weights))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for symbols, weights in zip(b.column(0), b.column(1), strict=True):
            yield np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(weights.as_buffer(), np.int64)


def _after(blocks: Iterable[tuple[np.ndarray, np.ndarray]], merges: Sequence[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks with these merges (x, y, merged) applied in order."""
    edges, wanted = _Edges([m[:2] for m in merges]), {_pair(x, y) for x, y, _ in merges}
    for symbols, weights in blocks:
        places = _Places(symbols, edges, wanted)
        for m in merges:
            places.merge(*m)
        yield _long(places.kept(), weights)


def _pair_counts(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours and how often each stands in a block."""
    there = np.zeros(int(symbols.max(initial=0)) + 1, bool)
    there[symbols] = True
    distinct = np.flatnonzero(there)
    place = np.zeros(len(there), np.int64)
    place[distinct] = np.arange(len(distinct))
    low, k = place[symbols], len(distinct)
    real = (symbols[:-1] > 0) & (symbols[1:] > 0)
    keys, n = (low[:-1] * k + low[1:])[real], np.repeat(weights, np.diff(np.flatnonzero(symbols == 0), prepend=-1))[:-1][real]
    if k * k > 16 * BLOCK:
        keys, n = _sums(keys, n)
    else:
        total = np.bincount(keys, n, k * k)  # exact up to 2^53
        keys = np.flatnonzero(total)
        n = total[keys].astype(np.int64)
    return distinct[keys // k] << 32 | distinct[keys % k], n


def _state(blocks: Iterable[tuple[np.ndarray, np.ndarray]], texts: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of STATE: the blocks, one to a batch, and the sums of their counts of pairs, by text."""
    binary, names = pa.binary(), [c.split()[0] for c in STATE.split(", ")]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        keys, n = summed()
        distinct, of = np.unique(np.concatenate([keys >> 32, keys & 0xFFFFFFFF]), return_inverse=True)
        text = pa.array([chr(d - 1) if d < _Symbols.FIRST else texts[d - _Symbols.FIRST] for d in distinct.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), binary), pa.nulls(len(keys), binary), text.take(pa.array(of[: len(keys)])), text.take(pa.array(of[len(keys) :])), pa.array(n)], names=names)

    def summed() -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return _sums(np.concatenate([none, *(k for k, _ in held)]), np.concatenate([none, *(n for _, n in held)]))

    for symbols, weights in blocks:
        if not len(weights):
            continue
        yield pa.RecordBatch.from_arrays([pa.array([symbols.tobytes()], binary), pa.array([weights.tobytes()], binary), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names=names)
        held.append(_pair_counts(symbols, weights))
        if sum(len(k) for k, _ in held) > 8 * BLOCK:
            held = [summed()]
            if len(held[0][0]) > 4 * BLOCK:
                yield counted()
                held = []
    yield counted()


def _cut(symbols: np.ndarray, weights: np.ndarray, hot: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The stretches of a block whose neighbours are hot, as bytes, and their words' counts."""
    borders = np.flatnonzero(np.concatenate([[True], ~hot, [True]]))
    size = np.diff(borders)
    start, size = borders[:-1][size > 1], size[size > 1]
    ends = np.cumsum(size)
    flat = symbols[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    stretch = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, np.int32))])
    return stretch, weights[np.cumsum(symbols == 0)[start]]


def _cut_beside(symbols: np.ndarray, weights: np.ndarray, pairs: Collection[tuple[int, int]], known: set[int]) -> tuple[pa.Array, list[int]]:
    """The `stretches` of a block as bytes, and their words' counts."""
    out, n = [], []
    for word, weight in zip(np.split(symbols, np.flatnonzero(symbols == 0) + 1)[:-1], weights.tolist(), strict=True):
        for s in stretches(word[:-1].tolist(), pairs, known):
            out.append(np.array(s, np.int32).tobytes())
            n.append(weight)
    return pa.array(out, pa.large_binary()), n


def _stretches(state: DataFrame, pairs: Collection[tuple[int, int]], known: set[int] | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct stretches of these pairs, a 0 after each, and their counts; None if they are more than the driver takes.

    With `known`, the `stretches` with what stands beside the pairs, else those that end with them. A task
    that has too many itself only says so.
    """
    most, long = STRETCHES, LONG

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("stretch").aggregate([("n", "sum")]).rename_columns(["stretch", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over, edges = [], False, _Edges(pairs)
        for symbols, weights in _blocks(batches):
            if over:
                continue
            stretch, n = _cut(symbols, weights, edges.among(symbols)) if known is None else _cut_beside(symbols, weights, pairs, known)
            held.append(summed([pa.table({"stretch": stretch, "n": pa.array(n, pa.int64())})]))
            if sum(t.num_rows for t in held) > 2 * held[0].num_rows:
                held = [summed(held)]
                over = held[0].num_rows > most or (pc.sum(pc.binary_length(held[0]["stretch"])).as_py() or 0) > 4 * most * long
        if over:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([0], pa.int64())], names=["stretch", "n"])
        elif held:
            yield from summed(held).cast(pa.schema([("stretch", pa.binary()), ("n", pa.int64())])).combine_chunks().to_batches(max_chunksize=10_000)

    cut = checkpointed(state.where("symbols is not null").select("symbols", "weights").mapInArrow(run, "stretch binary, n long").groupBy("stretch").agg(F.sum("n").alias("n")))
    total = cut.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("stretch")).alias("bytes"), F.count_if(F.col("stretch").isNull()).alias("over")).first()
    if total.over or total.n > most or (total.bytes or 0) > 4 * most * long:
        return None
    got = cut.toArrow()
    stretch = got["stretch"].combine_chunks()
    size = pc.binary_length(stretch).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return _ended(np.frombuffer(b"".join(stretch.to_pylist()), np.int32), size), got["n"].to_numpy()


def train(word_counts: DataFrame, merges: int, least: int = 2, most_pairs: int = FIRST_PAIRS) -> list[tuple[str, str]]:
    """Merges in order, each the most frequent pair (ties: first by text) with a count of at least `least`.

    The same merges as by counting all pairs anew after each one, whatever `most_pairs`, the pairs that
    the first phase looks at; later phases look at more or fewer, as their stretches are few or too
    many for the driver (STRETCHES). No words give no merges. Words are dealt over a fixed number of
    tasks: they are few bytes, but much work. Where the first of the pairs all have one count, their
    stretches are cut with what stands beside them.
    """
    n = int(word_counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = _Symbols()
    done: list[tuple[str, str]] = []
    state = checkpointed(word_counts.where(F.length("word") > 1).repartition(n).select("word", F.col("n").cast("long")).mapInArrow(lambda b: _state(_blocks_of_words(b), []), STATE))
    while len(done) < merges:
        counts = state.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        top = [tuple(r) for r in counts.orderBy(F.desc("n"), "a", "b").limit(MOST_PAIRS + 1).collect()]
        if not top:
            break
        while True:
            floor = top[most_pairs][2] if len(top) > most_pairs else least - 1
            pairs = {(a, b): k for a, b, k in top[:most_pairs] if k > floor}
            beside = not pairs  # the first ones all have one count
            pairs = pairs or {(a, b): k for a, b, k in top[:most_pairs]}
            known = {names.number(a + b) for a, b in pairs if a + b in names.numbers} if beside else None
            rows = _stretches(state, {(names.number(a), names.number(b)) for a, b in pairs}, known)
            if rows is not None or most_pairs == 1:
                break
            most_pairs = max(1, most_pairs // 2)
        new = [] if rows is None else _phase(rows, pairs, floor, set(names.numbers), merges - len(done), least, names, beside)
        new = new or [top[0][:2]]
        if rows is not None and 2 * len(rows[1]) < STRETCHES and 2 * len(rows[0]) < STRETCHES * LONG:
            most_pairs = min(MOST_PAIRS, 2 * most_pairs)
        done += new
        if len(done) < merges:
            steps, texts = [(names.number(a), names.number(b), names.number(a + b)) for a, b in new], list(names.texts)
            state = checkpointed(state.where("symbols is not null").select("symbols", "weights").mapInArrow(lambda b, steps=steps, texts=texts: _state(_after(_blocks(b), steps), texts), STATE))
    return done


def train_vocabulary(df: DataFrame, text: str, size: int, least: int = 2) -> list[tuple[str, str]]:
    """Byte-level merges for a vocabulary of `size`: special tokens, 256 bytes, then one token a merge."""
    return train(words(df, text, byte_words), max(0, size - len(SPECIALS) - 256), least)


def vocabulary(merges: Sequence[tuple[str, str]]) -> dict[str, int]:
    """Ids of the special tokens, then of the bytes in the order of their symbols, then of the merges."""
    names = [*SPECIALS, *sorted(byte_symbols()), *(a + b for a, b in merges)]
    return {n: i for i, n in enumerate(dict.fromkeys(names))}


def segment(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word's pieces: the pair of least rank is merged everywhere, until none is left."""
    p = list(word)
    while len(p) > 1:
        best = min(zip(p, p[1:], strict=False), key=lambda x: ranks.get(x, len(ranks)))
        if best not in ranks:
            break
        p = merged(p, *best)
    return p


def encode(df: DataFrame, key: str, text: str, merges: Sequence[tuple[str, str]], cut=blank_words, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (key, keep..., pieces): the pieces of a text's pre-tokens in order. Null texts have none.

    A batch cuts each of its words once, and a task keeps those of the batches before.
    """
    ranks = {m: i for i, m in enumerate(merges)}
    symbols = byte_symbols() if cut is byte_words else None
    kind = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in batches:
            many = b.column(b.num_columns - 1)
            flat = many.flatten().dictionary_encode()
            if len(known) >= MEMORY:
                known.clear()
            for w in flat.dictionary.to_pylist():
                if w not in known:
                    known[w] = segment(w if symbols is None else "".join(symbols[x] for x in w.encode()), ranks)
            cuts = pa.array([known[w] for w in flat.dictionary.to_pylist()], kind).take(flat.indices)
            starts = many.offsets.to_numpy() - many.offsets[0].as_py()
            ends = cuts.offsets.to_numpy() - (cuts.offsets[0].as_py() if len(cuts) else 0)
            pieces = pa.ListArray.from_arrays(pa.array(ends[starts], pa.int32()), cuts.flatten())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pieces], names=[*names, "pieces"])

    names = [key, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(*names, (_pre_tokens(whole) if cut is byte_words else cut(whole)).alias("_w")).mapInArrow(run, f"{schema}, pieces array<string>")


def decode(df: DataFrame, key: str, pieces: str = "pieces") -> DataFrame:
    """Rows (key, text): pieces without their words' borders, joined."""
    return df.select(key, F.array_join(pieces, "").alias("text"))


def decode_bytes(df: DataFrame, key: str, pieces: str = "pieces") -> DataFrame:
    """Rows (key, text) of byte-level pieces: their characters back as bytes, blanks and all, the one before the text too."""
    return df.select(key, unspelt(F.array_join(pieces, "")).alias("text"))


def unspelt(word: Column) -> Column:
    """The text of a string of byte_symbols."""
    plain, symbols = _respelt()
    zero = symbols[0]  # the symbol of byte 0, which translate would drop
    latin = F.replace(F.translate(word, symbols[1:], plain[1:]), F.lit(zero), F.lit("\x00"))
    return F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")
