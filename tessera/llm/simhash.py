"""SimHash near-duplicates through Golay-code keys.

A fingerprint is cut into segments of at most 23 bits. The binary Golay code puts each 23-bit word
within three errors of exactly one codeword. A segment's keys are the codewords nearest to it and to
its neighbours at one bit: two segments that differ in two bits or fewer share a neighbour, and so a
key. How many segments of two linked fingerprints can have more errors follows by the pigeonhole
principle, and that decides which segments are combined into one join key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, stored, table

#: Segments (lane, first bit, width) of one 64-bit lane.
ONE_LANE = ((0, 0, 23), (0, 23, 23), (0, 46, 18))
#: A bucket of up to so many members is compared pair by pair; larger ones go another way.
SMALL_BUCKET = 8
_GOLAY: list[np.ndarray] = []


def golay_decoder() -> np.ndarray:
    """For each 23-bit word, the number of its nearest codeword in the binary Golay code."""
    if not _GOLAY:
        messages = np.arange(4096, dtype=np.int64)
        code = np.zeros(4096, dtype=np.int64)
        for k in (0, 1, 5, 6, 7, 9, 11):  # the generator polynomial's powers of x
            code ^= messages << k
        flips = [0] + [sum(1 << i for i in c) for n in (1, 2, 3) for c in itertools.combinations(range(23), n)]
        table_ = np.zeros(1 << 23, dtype=np.int16)
        for f in flips:
            table_[code ^ f] = messages
        _GOLAY.append(table_)
    return _GOLAY[0]


def segment_keys(words: np.ndarray, width: int) -> list[np.ndarray]:
    """Codeword numbers of each segment value and of its one-bit neighbours, without repeats."""
    flips = np.array([0] + [1 << i for i in range(width)], dtype=np.int64)
    near = np.sort(golay_decoder()[words[:, None] ^ flips[None, :]], axis=1)
    new = np.ones(near.shape, dtype=bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return [row[m].astype(np.int64) for row, m in zip(near, new, strict=True)]


def key_plans(n_segments: int, bits: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(exact segments, Golay segments) of each key, so that fingerprints within `bits` share one.

    With fewer errors than segments one segment has none: it is taken as it is, with the Golay keys
    of the next one. Else every set of the segments that must have two errors or fewer is taken.
    """
    if bits < n_segments and bits <= 2:
        return [((i,), ((i + 1) % n_segments,)) for i in range(n_segments)]
    sound = n_segments - bits // 3
    if sound < 1:
        raise ValueError("too many bits for these segments")
    return [((), c) for c in itertools.combinations(range(n_segments), sound)]


def fingerprint(features: list[bytes], seeds: tuple[int, ...] = (42,)) -> list[int]:
    """A 64-bit lane per seed; a bit is 1 if it is set in over half of the features' XXH64. None: 0."""
    out = []
    for seed in seeds:
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(features), 65536):
            h = np.array([xxhash.xxh64_intdigest(x, seed) for x in features[at : at + 65536]], dtype="<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = (2 * ones > len(features)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def shingles(text: bytes, n: int) -> list[bytes]:
    """Word n-grams of the text with A-Z lower-cased, repeats included; the whole if it has fewer words."""
    w = text.lower().split()
    if len(w) < n:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))


def golay_keys(df: DataFrame, lanes: list[str], carry: list[str], segments, bits: int) -> DataFrame:
    """Rows (key, carried columns, lanes): each fingerprint with each of its keys."""
    plans, schema = key_plans(len(segments), bits), "key long, " + ", ".join(f"{c} long" for c in [*carry, *lanes])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                values = [b.column(len(carry) + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(lanes))]
                cut = [(values[lane].view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1) for lane, first, width in segments]
                fuzzy = [segment_keys(c, s[2]) for c, s in zip(cut, segments, strict=True)]
                keys, rows = [], []
                for p, (exact, golay) in enumerate(plans):
                    for i in range(b.num_rows):
                        k = np.array([p], dtype=np.int64)
                        for e in exact:
                            k = k << 23 | cut[e][i]
                        for g in golay:
                            k = (k[:, None] << 12 | fuzzy[g][i][None, :]).ravel()
                        keys.append(k)
                        rows.append(i)
                take = np.repeat(rows, [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)), *(b.column(j).take(pa.array(take)) for j in range(b.num_columns))], names=["key", *carry, *lanes])

    return df.select(*carry, *lanes).mapInArrow(expand, schema)


def simhash(df: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """df with fp, the fingerprint of its word shingles as a signed long. Null and empty texts: 0."""

    def hash_(s: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingles(t or b"", words))[0] for t in s.cast(pa.large_binary()).to_pylist()], pa.int64())

    return df.withColumn("fp", F.arrow_udf(hash_, "long")(F.col(text).cast("string")))


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that join all `node`s of distinct fingerprints `fp` that differ in two bits or fewer.

    Fingerprints that share a Golay key are candidates. Buckets of up to SMALL_BUCKET members are
    joined to themselves and each pair verified. Members of larger buckets are filed under themselves
    and their one-bit neighbours: two within two bits meet at one of these and any two that meet are
    within two bits, so the least member of each, at most 65 strong, is linked to the others. That
    keeps every component and makes 65 rows a fingerprint, however large the bucket.
    """
    keyed = stored(golay_keys(prints, ["fp"], ["node"], ONE_LANE, 2), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = keyed.join(sizes.where(F.col("n") <= SMALL_BUCKET), "key").select("key", "node", "fp")
    other = few.select("key", F.col("node").alias("node2"), F.col("fp").alias("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2
    pairs = few.join(other, "key").where((F.col("node") < F.col("node2")) & near).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    many = keyed.join(sizes.where(F.col("n") > SMALL_BUCKET), "key").select("node", "fp").distinct()
    flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    hubs = many.select("node", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in flips])).alias("hub"))
    met = hubs.groupBy("hub").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
    return pairs.unionByName(met.select("a", F.explode("all").alias("b"))).where("a <> b").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of df: key, fingerprint (16 hex digits), component_id.

    Fingerprints of `words`-word shingles link at two or fewer differing bits; component_id is the
    least key that can be reached. Texts without words (null, empty, blank) have fingerprint zero and
    link like any other. Equal fingerprints are one node, so groups of copies of any size cost one
    row; repeated rows keep their own row. A row with a null key links like any other, and its
    component_id is null only if no key can be reached; a key with two texts has a row for each, whose
    fingerprints are not linked by that. An empty table gives no rows.
    """
    prints = stored(simhash(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", words).select("key", "fp"), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("fp")), "nodes")
    found = components(stored(link_fingerprints(nodes.select("fp", "node")), "links"))
    placed = stored(nodes.join(found, "node", "left").select("fp", "n", "least", F.coalesce("component", "node").alias("component")), "placed")
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "n", "component_id")
    return lookup(prints, stored(named, "named"), "fp", "n").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
