"""MinHash near-duplicates: bands find candidates, odd sketches judge them, full sets confirm them.

The MinHash samples of a set are cut into bands, and sets with an equal band are candidates. The same
samples are folded into a bitmap in which each sample flips one bit. The bits in which two such odd
sketches differ tell how many samples differ, most precisely where few do: candidates that are clearly
below the similarity asked for go without their texts being read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, remove_folder, shared_folder, table, texts, word_hashes
from .near_copies import nearest, shingle_set, verified

#: Two sets of similarity 0.8 share none of 64 bands of 7 with probability 3e-7; one of 0.4 shares one with 0.1.
BANDS, ROWS = 64, 7
SAMPLES, BITS = BANDS * ROWS, 1024
#: Standard deviations by which a sketch may be wrong; members of a block of sketches, and of one of texts, that is compared with another.
SURE, BLOCK, TEXT_BLOCK = 5, 1000, 256
#: Sets that a task knows again.
KNOWN = 200_000
_ODD = np.random.default_rng(13).integers(1 << 31, size=(3, SAMPLES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(grams: np.ndarray) -> np.ndarray:
    """The least value of the set under each of SAMPLES permutations of 32-bit hashes; the set is not empty."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, ((low[at : at + 512, None] ^ _ODD[0]) * _ODD[1]).min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """For each row of samples the keys of its bands."""
    rows = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = (key ^ rows[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
        key = key ^ key >> np.uint64(29)
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """For each row of samples a bitmap of BITS: a bit is set if an odd number of samples falls on it."""
    mixed = (samples ^ _ODD[2]) * np.uint32(0x9E3779B1)
    mixed = (mixed ^ mixed >> np.uint32(15)) * _ODD[1][::-1]
    bit = (mixed >> np.uint32(32 - int(math.log2(BITS)))).astype(np.int64)
    flat = np.bincount((bit + np.arange(len(samples))[:, None] * BITS).ravel(), minlength=len(samples) * BITS)
    return np.packbits((flat & 1).astype(np.uint8).reshape(-1, BITS), axis=1)


def most_bits(similarity: float) -> int:
    """Differing bits that sketches of this similarity have at most, but for SURE standard deviations.

    A differing sample flips two bits, and n flips leave BITS / 2 * (1 - exp(-2 n / BITS)) bits odd.
    """
    differ, spread = SAMPLES * (1 - similarity), math.sqrt(SAMPLES * similarity * (1 - similarity))
    odd = lambda n: BITS / 2 * (1 - math.exp(-4 * n / BITS))
    folding = math.sqrt(BITS / 4 * (1 - math.exp(-8 * differ / BITS)))
    return math.ceil(odd(differ) + SURE * math.hypot(odd(differ + spread) - odd(differ), folding))


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def _longs(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """Rows (id, key, n, same, sketch, bands): a set's size and digest; sketch and bands where a task first meets it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            n, same, rows, samples = [], [], [], []
            for i, t in enumerate(texts(b, "_text")):
                grams = shingle_set(word_hashes(t.lower().split()), words)
                n.append(len(grams))
                same.append(xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63))
                if len(grams) and same[-1] not in known:
                    known.add(same[-1])
                    rows.append(i)
                    samples.append(minhashes(grams))
            if len(known) > KNOWN:
                known.clear()
            place = np.full(b.num_rows, -1)
            place[rows] = np.arange(len(rows))
            take = pa.array(place, mask=place < 0)
            held = np.array(samples, dtype=np.uint32).reshape(-1, SAMPLES)
            sketch = pa.array([x.tobytes() for x in odd_sketches(held)] if rows else [], pa.binary()).take(take)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(held).ravel())).take(take)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(same, pa.int64()), sketch, bands], names=["id", "key", "n", "same", "sketch", "bands"])

    return docs.mapInArrow(build, "id long, key long, n long, same long, sketch binary, bands array<long>")


def _close(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches differ in at most `most` bits."""

    def judge(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(_differing(_longs(x), _longs(y)), pa.int32())

    named = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")).dropDuplicates([c])
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.where(F.arrow_udf(judge, "int")("sketch_a", "sketch_b") <= most).select("a", "b")


class _Joined:
    """Sets of numbers that are joined one pair at a time."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (up := self.root.get(x, x)) != x:
            path.append(x)
            x = up
        self.root.update(dict.fromkeys(path, x))
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart before."""
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


def _blocks(rows: DataFrame, by: str, size: int) -> DataFrame:
    """Rows (by, i, j, side, ...) of rows (by, node, comp, ...): the pairs of blocks in which the members of each
    group meet all others that are in another component.

    The members of a group's most frequent component are joined already, and meet the others only.
    """
    counts = rows.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"))
    parts = lambda n: F.ceil(n / size).cast("int")
    counts = counts.where("comps > 1").select(by, F.col("top.comp").alias("top"), parts(F.col("n") - F.col("top.n")).alias("lefts"), parts(F.col("n")).alias("rights"))
    dealt, block = rows.join(counts, by), lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = dealt.where("comp <> top").withColumn("j", every("rights")).withColumn("i", block("lefts")).withColumn("side", F.lit(0))
    right = dealt.withColumn("i", every("lefts")).withColumn("j", block("rights")).withColumn("side", F.lit(1))
    return left.unionByName(right.select(*left.columns)).drop("lefts", "rights")


def _sides(group: pa.Table) -> tuple[np.ndarray, ...]:
    """node, comp, the places of the left and of the right members, and whether two of these may be compared."""
    side, node, comp, top = (group[c].to_numpy() for c in ("side", "node", "comp", "top"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    meets = lambda x: (comp[right] != comp[x]) & ((comp[right] == top[right]) | (node[x] < node[right]))
    return node, comp, left, right, meets


def _clumps(nodes: DataFrame, most: int, kept) -> DataFrame:
    """Rows (clump, node, comp): nodes that are close to nodes of other components `comp`, directly or through others.

    Nodes that share a band are compared by their sketches. Of the pairs that are close a task gives a
    forest only, so that rows stay in proportion to the nodes, however many pairs are close.
    """
    rows = nodes.select("node", "comp", F.explode("bands").alias("key"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rows = kept(rows.join(mixed, "key"), "mixed")
    dealt = _blocks(rows, "key", BLOCK).join(nodes.select("node", "sketch").dropDuplicates(["node"]), "node")

    def compare(group: pa.Table) -> pa.Table:
        node, _, left, right, meets = _sides(group)
        sketch, seen, out = _longs(group["sketch"]), _Joined(), []
        for x in left:
            hit = right[meets(x) & (_differing(sketch[right], sketch[x]) <= most)]
            out += [(int(node[x]), int(node[y])) for y in hit if seen.join(int(node[x]), int(node[y]))]
        a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    edges = kept(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "close")
    clumps = components(edges).withColumnRenamed("component", "clump")
    return kept(clumps.join(nodes.select("node", "comp").dropDuplicates(["node"]), "node"), "clumps")


def _links(clumps: DataFrame, docs: DataFrame, words: int, similarity: float, kept) -> DataFrame:
    """Rows (a, b): links between components, enough to join all that links of this similarity join.

    The members of a clump meet in blocks of texts; a text goes to each pair of blocks once, not to
    each of its partners, and of the links found a task gives a forest.
    """
    dealt = kept(_blocks(clumps, "clump", TEXT_BLOCK), "dealt")
    rows = docs.join(dealt, docs["id"] == dealt["node"]).select("clump", "i", "j", "side", "node", "comp", "top", "_text", F.xxhash64("_text").alias("same"))
    rows = rows.dropDuplicates(["clump", "i", "j", "side", "node", "same"])  # repeated rows

    def compare(group: pa.Table) -> pa.Table:
        node, comp, left, right, meets = _sides(group)
        sets = [shingle_set(word_hashes(t.lower().split()), words) for t in texts(group.combine_chunks().to_batches()[0], "_text")]
        sizes = np.array([len(x) for x in sets])
        owner, flat = np.repeat(np.arange(len(right)), sizes[right]), np.concatenate([sets[y] for y in right])
        order = np.argsort(flat, kind="stable")
        flat, owner, joined, out = flat[order], owner[order], _Joined(), []
        for x in left:
            may = meets(x)
            if not may.any():
                continue
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(owner[at], minlength=len(right))
            alike = may & (both >= similarity * (sizes[right] + sizes[x] - both) - 1e-9) & (both > 0)
            out += [(int(node[x]), int(node[y])) for y in right[alike] if joined.join(int(comp[x]), int(comp[y]))]
        a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return kept(rows.groupBy("clump", "i", "j").applyInArrow(compare, "a long, b long"), "links")


def minhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id, kept, for texts of this Jaccard similarity.

    A text's set has its distinct `words`-word shingles with A-Z lower-cased, the whole sequence if it
    has fewer words. Texts are linked if their sets' similarity is at least `similarity`; every link is
    confirmed on the full sets. component_id is the least key that can be reached, kept is true for its
    row. Sets that share a band are first compared with the least member of each bucket, which leaves
    few components of a group of near copies, however large; then members of different components by
    their sketches, and those that are close by their full sets. A pair is missed only if no band is
    shared (3e-7 at 0.8) or its sketches are off by five standard deviations, and if no chain of other
    pairs joins it.

    Null, empty and blank texts have no set and are linked with nothing. Rows with equal sets are one
    node and keep their own row. Rows of one key are one document. Rows with a null key take part:
    their component_id is the least key in reach, null if there is none, and they are kept then.
    An empty table gives no rows. Only the columns named are read.
    """
    spark, paths = df.sparkSession, []

    def kept(frame: DataFrame, name: str) -> DataFrame:
        paths.append(shared_folder(spark, name))
        frame.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    own = F.coalesce(F.col("key"), F.xxhash64("_text").bitwiseOR(F.lit(-(1 << 63)).cast("long")))
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("_text")).select(own.alias("id"), "key", "_text")
    sketched = kept(_sketched(docs, words), "sketched")
    alone, members = sketched.where("n = 0"), sketched.where("n > 0")
    repeats = not members.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty()
    sets = members.where("bands is not null").groupBy("same").agg(F.min(F.struct("id", "sketch", "bands")).alias("x"))
    nodes = kept(sets.select("same", F.col("x.id").alias("node"), "x.sketch", "x.bands"), "sets")
    most, whole = most_bits(similarity), docs.select("id", "_text")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return verified(kept(pairs, "pairs"), whole, words, similarity, repeats, kept)

    def joined(edges: DataFrame) -> DataFrame:
        return kept(nodes.join(components(edges), "node", "left").select(*nodes.columns, F.coalesce("component", "node").alias("comp")), "joined")

    keys = nodes.select("node", F.explode("bands").alias("band"))
    heads = keys.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    edges = confirmed(_close(nearest(keys.join(heads, "band").select("a", F.col("node").alias("b"))), nodes, most))
    first = joined(edges)
    clumps = _clumps(first, most, kept)
    if not clumps.isEmpty():
        first = joined(edges.unionByName(_links(clumps, whole, words, similarity, kept)))
    rows = members.groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("least"))
    rows = rows.join(first.select("same", "comp"), "same")
    named = rows.join(rows.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("same", "rows", "component_id")
    found = lookup(members.select("key", "n", "same"), kept(named, "named"), "same", "rows").select("key", "n", "component_id")
    out = kept(found.unionByName(alone.select("key", "n", F.col("key").alias("component_id"))), "minhash-groups")
    for path in paths[:-1]:
        remove_folder(spark, path)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark, sf_dir):
    return minhash_groups(table(spark, sf_dir, "documents"))
