"""Benchmark decontamination by spaced seeds.

A mask picks some token positions of a window and ignores the others, so that a hit survives
substitutions at the ignored places. Hashes of the picked tokens at every window of the corpus are
joined to those of the benchmark; each hit gives an alignment, along which the texts are compared
token by token. The masks are light: chance hits are left to that comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, row_without, stored, table, texts, word_hashes

#: Masks over a window: 1 picks a position. One of them hits wherever a passage of 13 to 26 tokens is
#: equal to a share of 0.8, whichever inner tokens are substituted (all cases are gone through in a test).
MASKS = ("1111011", "110000010111", "1100110100001", "1010000011011")
#: Tokens of a verified overlap at least, and the share of them that must be equal.
LEAST_TOKENS, LEAST_EQUAL = 13, 0.8
#: Bits of each half of the filter of benchmark hashes that goes to every task, whatever the benchmark's size.
FILTER_BITS = 24
#: The benchmark's windows are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_WINDOWS = 500_000
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def token_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each token; tokens are runs of characters other than ASCII marks and blanks, in lower case."""
    words = (text if text.isascii() else text.decode().lower().encode()).translate(_PARTS).split()
    return word_hashes(words)


def mask_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the picked tokens of each window, as unsigned 64-bit numbers."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, len(mask) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ tokens[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return h


def _text_windows(tokens: np.ndarray, masks, whole: int) -> Iterator[tuple[int, np.ndarray]]:
    """(mask number, hashes of all windows). Texts of fewer tokens than `whole` have one window more,
    their whole, whose mask number is its negative length."""
    for m, mask in [*masks, *([(-len(tokens), "1" * len(tokens))] if 0 < len(tokens) < whole else [])]:
        h = mask_hashes(tokens, mask)
        if len(h):
            yield m, h


def benchmark_windows(benchmark: DataFrame, item: str, text: str, least: int) -> DataFrame:
    """Rows (item, mask, item_at, hash) of every window of the items; items with a null id have none."""
    masks = list(enumerate(MASKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts(b, "_text"), strict=True):
                for m, h in _text_windows(token_hashes(t), masks, least):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(h), pa.int64()), pa.array(np.full(len(h), m, dtype=np.int32)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))], names=["item", "mask", "item_at", "hash"])

    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(cut, "item long, mask int, item_at int, hash long")


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent places of each hash in the halves of the filter."""
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), ((h >> np.uint64(64 - 2 * FILTER_BITS)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) + (1 << FILTER_BITS)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def hash_filter(bench: DataFrame) -> np.ndarray:
    """Packed bits, two for each benchmark hash: 4 MB at any size. It lets all of them pass, and few others."""
    size = 1 << (FILTER_BITS - 12)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(2 << FILTER_BITS, dtype=np.uint8)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                bits[at] = 1
        part = np.packbits(bits, bitorder="little").reshape(-1, size // 8)
        at = np.flatnonzero(part.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([part[i].tobytes() for i in at], pa.binary())], names=["part", "bits"])

    rows = bench.select("hash").mapInArrow(pack, "part long, bits binary").groupBy("part").agg(F.collect_set("bits").alias("all"))
    out = np.zeros((2 << FILTER_BITS) // 8, dtype=np.uint8).reshape(-1, size // 8)
    for r in rows.toLocalIterator():
        for one in r["all"]:
            out[r.part] |= np.frombuffer(one, dtype=np.uint8)
    return out.ravel()


def _hits(docs: DataFrame, key: str, text: str, masks: dict[int, str], bits: np.ndarray) -> DataFrame:
    """Rows (doc, id, tokens, hits) of the texts with a window that passes the filter; `doc` names a row by
    its id, and where that is null by its text."""
    numbered = list(masks.items())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts(b, "_text"), strict=True):
                tokens = token_hashes(t)
                found = []
                for m, h in _text_windows(tokens, numbered, 0):
                    one, two = _places(h)
                    at = np.flatnonzero(_has(bits, one))
                    at = at[_has(bits, two[at]) > 0]
                    found += [{"mask": m, "at": int(x), "hash": int(v)} for x, v in zip(at, h[at].view(np.int64), strict=True)]
                if found:
                    name = hashlib.md5(t).hexdigest() if i is None else str(i)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([tokens.tobytes()], pa.binary()), pa.array([found], pa.list_(pa.struct([("mask", pa.int32()), ("at", pa.int32()), ("hash", pa.int64())])))], names=["doc", "id", "tokens", "hits"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(cut, "doc string, id long, tokens binary, hits array<struct<mask:int,at:int,hash:long>>")


def maximal(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, length, equal) those whose span lies in no other's; of equal spans the one with most equal tokens."""
    out, end = [], -1
    for start, n, same in sorted(found, key=lambda x: (x[0], -x[1], -x[2])):
        if start + n > end:
            out.append((start, n, same))
            end = start + n
    return out


def _longest_run(same: np.ndarray, least: int, equal: float) -> tuple[int, int] | None:
    """Start and length of the longest run between equal tokens with at least this share of equal ones."""
    if same.sum() < equal * least - 1e-9:
        return None
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0 - equal, -equal))])
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    starts = np.flatnonzero(same)
    ends = np.searchsorted(-ahead, 1e-9 - total[starts], side="right") - 1  # the last places where the total is no less
    last = np.maximum.accumulate(np.where(same, np.arange(len(same)), -1))[ends - 1]
    k = int(np.argmax(last - starts))
    n = int(last[k] - starts[k]) + 1
    return (int(starts[k]), n) if n >= least else None


def overlaps(a: np.ndarray, b: np.ndarray, shift: int, least: int, equal: float) -> list[tuple[int, int, int]]:
    """Maximal runs (start in a, length, equal tokens) along the alignment a[i] ~ b[i - shift].

    A run begins and ends with an equal token and has at least `least` tokens, of which at least the
    share `equal` are equal. Each equal token scores 1 - equal and each other one -equal; a run grows
    until its score falls below zero or six substitutions below its best, and ends at its best. In the
    room beside such runs the longest run that fits is taken, so that an early substitution hides none.
    """
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi - lo < least:
        return []
    same = a[lo:hi] == b[lo - shift : hi - shift]
    score = np.where(same, 1.0 - equal, -equal)
    if same.sum() < equal * least - 1e-9:
        return []
    out, i = [], 0
    total = best = 0.0
    start = best_end = None
    for i, s in enumerate(score):
        if start is None:
            if not same[i]:
                continue
            start, total, best, best_end = i, 0.0, -1.0, i
        total += s
        if total >= best:
            best, best_end = total, i
        if total < -1e-9 or i == len(score) - 1 or total < best - 6 * equal:
            n = best_end - start + 1
            if n >= least and same[start : best_end + 1].mean() >= equal:
                out.append((lo + start, int(n), int(same[start : best_end + 1].sum())))
            start = None
    edges = [0, *(x for at, n, _ in out for x in (at - lo, at - lo + n)), hi - lo]
    room = list(zip(edges[::2], edges[1::2], strict=True))
    while room:
        x, y = room.pop()
        run = _longest_run(same[x:y], least, equal) if y - x >= least else None
        if run:
            at, n = x + run[0], run[1]
            out.append((lo + at, n, int(same[at : at + n].sum())))
            room += [(x, at), (at + n, y)]
    return sorted(out)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST_TOKENS, equal: float = LEAST_EQUAL) -> DataFrame:
    """Rows (key, digest, item, start, length, equal): verified overlaps, in tokens of the document.

    An overlap that lies within another of the same document and item is left out. Benchmark items of
    fewer tokens than `least` must be there whole: their own hash finds them where all tokens are
    equal, and with substitutions they are found where a mask of their length or less hits. Null texts
    count as empty. Documents with a null key are checked by their text: their rows have the text's
    MD5 as digest, which is null for others. Items with a null id are left out; an empty benchmark or
    table gives no rows; repeated rows give their overlaps once. The corpus is read once, and only the
    tokens of documents with hits are written or shuffled.
    """
    bench = stored(benchmark_windows(benchmark, item, item_text, least), "benchmark-windows")
    masks = {r["mask"]: MASKS[r["mask"]] if r["mask"] >= 0 else "1" * -r["mask"] for r in bench.select("mask").distinct().collect()}
    hits = stored(_hits(docs, key, text, masks, hash_filter(bench)), "hits")
    small = F.broadcast if bench.count() <= BROADCAST_WINDOWS else (lambda x: x)  # else Spark splits skewed partitions
    aligned = hits.select("doc", F.explode("hits").alias("h")).select("doc", "h.*").join(small(bench), ["mask", "hash"]).select("doc", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.coalesce(item_text, F.lit("")).alias("_item")).distinct()
    shifts = stored(aligned.groupBy("doc", "item").agg(F.collect_list("shift").alias("shifts")), "alignments")
    wanted = shifts.join(items, "item").groupBy("doc").agg(F.collect_list(F.struct("item", "shifts", "_item")).alias("to"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for b in batches:
            got = []
            for doc, i, data, to in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                a = np.frombuffer(data, dtype=np.uint64)
                for x in to:
                    other = token_hashes(x["_item"].encode())
                    spans = {o for shift in x["shifts"] for o in overlaps(a, other, shift, min(least, len(other)), equal)}
                    got += [(doc if i is None else None, i, x["item"], *o) for o in maximal(spans)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["digest", "id", "item", "start", "length", "equal"])

    found = hits.select("doc", "id", "tokens").join(wanted, "doc").mapInArrow(verify, "digest string, id long, item long, start int, length int, equal int").distinct()
    return found.select(F.col("id").alias(key), "digest", F.col("item").alias(item), "start", "length", "equal")


def _judged(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, **options) -> DataFrame:
    """Rows (row, items, longest): each row of docs as a struct; the two are null where there is no overlap."""
    found = stored(find_overlaps(docs, benchmark, key, text, item, **options), "overlaps")
    sums = found.groupBy(F.col(key).alias("key"), "digest").agg(F.count_distinct(item).alias("items"), F.max("length").alias("longest"))
    named, other = sums.where("key is not null").drop("digest"), sums.where("key is null").drop("key")
    rows = docs.select(row_without(docs).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    known = rows.where("key is not null").join(named, "key", "left").select("row", "items", "longest")
    rest = rows.where("key is null").withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(other, "digest", "left")
    return known.unionByName(rest.select("row", "items", "longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """docs with n_items (benchmark items with an overlap), longest (tokens of the longest overlap) and contaminated.

    Columns of docs with those names are replaced. An empty benchmark contaminates nothing. Nulls and
    repeated rows are as find_overlaps says.
    """
    out = _judged(docs, benchmark, key, text, item, **options)
    return out.select(*columns_of(docs, "n_items", "longest", "contaminated"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("longest", F.lit(0)).alias("longest"), F.col("items").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """The rows of docs without an overlap, all columns as they are."""
    return _judged(docs, benchmark, key, text, item, **options).where("items is null").select(*columns_of(docs))


def op4_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")
