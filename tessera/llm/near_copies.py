"""Near copies by the similarity of word shingles: Golay keys of a fingerprint, joined and verified.

A 110-bit fingerprint of the distinct words has five segments without common bits. Two texts within
14 bits have a segment with two errors or fewer, and so a Golay key of it in common. That search finds
nearly all similar texts and leaves few components; an exact join of rare shingles then brings
together what it left apart. Texts themselves are read where they are: only the few that are to be
compared are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, lookup, remove_folder, shared_folder, stored, texts, word_hashes
from .simhash import segment_keys

#: Disjoint segments (lane, first bit, width) of two lanes, 110 bits.
WIDE = ((0, 0, 23), (0, 23, 23), (1, 0, 23), (1, 23, 23), (1, 46, 18))
_MIXERS = tuple(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(1, len(WIDE) + 1))
#: Candidates of a text that are verified after each search by fingerprints, those with most keys in common first.
NEAREST = 2
#: Texts that one call compares with one text; wanted texts up to which their ids are broadcast.
PART_TEXTS, BROADCAST_IDS = 64, 1_000_000
#: Cells in which shingles are counted, by their leading bits, to put rare ones first; members of a salted part.
CELL_BITS, SALT_ROWS = 22, 2000
#: The class of a cell from which its shingles may be frequent (50,000 in it), and the tasks over which these are dealt.
FREQUENT, SALTS = 125, 64
#: The ratio of the greatest to the least size of a band; sets that a task knows again.
BAND, KNOWN = 1.05, 200_000


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of word hashes; of the whole if it has fewer; none without words."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = h * np.uint64(_MIXERS[k])
    return h ^ (h >> np.uint64(31))


def word_lanes(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit lanes; a bit is 1 if it is set in over half of the distinct words' hashes. None: 0."""
    one, ones = np.unique(words), np.zeros(128, dtype=np.int64)
    for at in range(0, len(one), 65536):
        h = one[at : at + 65536]
        two = np.stack([h, _mixed(h, 0)], axis=1).astype("<u8")
        ones += np.unpackbits(two.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    lo, hi = np.packbits(2 * ones > len(one), bitorder="little").view("<i8")
    return int(lo), int(hi)


def _words(text: bytes) -> np.ndarray:
    return word_hashes(text.lower().split())


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """Rows (id, same, lo, hi, least): a digest of the shingle set, the lanes, the set's least hash under each mixer."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, lanes, least = [], [], []
            for t in texts(b, "_text"):
                w = _words(t)
                g = shingle_set(w, words)
                lanes.append(word_lanes(w))
                same.append(xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63))
                least.append([int(_mixed(g, k).min()) - (1 << 63) if len(g) else 0 for k in range(len(WIDE))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.int64()), *(pa.array([x[i] for x in lanes], pa.int64()) for i in (0, 1)), pa.array(least, pa.list_(pa.int64()))], names=["id", "same", "lo", "hi", "least"])

    return docs.mapInArrow(build, "id long, same long, lo long, hi long, least array<long>")


def _segments(nodes: DataFrame) -> DataFrame:
    """Rows (segment, bits, least, node): each node with each segment of its fingerprint and a least hash."""
    one = [F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("lo" if lane == 0 else "hi", first).bitwiseAND((1 << width) - 1).alias("bits"), F.element_at("least", s + 1).alias("least")) for s, (lane, first, width) in enumerate(WIDE)]
    return nodes.select("node", F.explode(F.array(*one)).alias("x")).select("x.segment", "x.bits", "x.least", "node")


def _golay_keys(cells: DataFrame) -> DataFrame:
    """Rows (key, node): the Golay keys of each cell's segment, each together with its least hash."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                segment, bits, least, node = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                for s, (_, _, width) in enumerate(WIDE):
                    own = segment == s
                    near = segment_keys(bits[own], width)
                    sizes = [len(x) for x in near]
                    codes = np.concatenate([*near, np.empty(0, dtype=np.int64)]).astype(np.uint64)
                    key = (np.repeat(least[own].view(np.uint64), sizes) ^ (codes << np.uint64(3) | np.uint64(s))) * np.uint64(0xD6E8FEB86659FD93)
                    yield pa.RecordBatch.from_arrays([pa.array((key ^ (key >> np.uint64(32))).view(np.int64)), pa.array(np.repeat(node[own], sizes))], names=["key", "node"])

    return cells.select("segment", "bits", "least", "node").mapInArrow(expand, "key long, node long")


def nearest(met: DataFrame) -> DataFrame:
    """Rows (b, a): for each b the NEAREST that it meets most often, ties to the lesser."""
    counts = met.where("a < b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("b").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "a"))), 1, NEAREST).alias("x"))
    return best.select("b", F.explode("x.a").alias("a"))


def _segment_pairs(nodes: DataFrame, kept) -> DataFrame:
    """Candidates of nodes that have a whole segment and its least hash in common: each with the least such nodes."""
    rows = kept(_segments(nodes), "segments")
    cells = rows.groupBy("segment", "bits", "least").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    return nearest(rows.join(cells, ["segment", "bits", "least"]).select("a", F.col("node").alias("b")))


def _golay_pairs(nodes: DataFrame, kept) -> DataFrame:
    """Candidates of nodes that have a Golay key in common: each with the least node of its buckets."""
    keyed = kept(_golay_keys(_segments(nodes)), "golay-keys")
    heads = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    return nearest(keyed.join(heads, "key").select("a", F.col("node").alias("b")))


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, repeats: bool, kept) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have at least this Jaccard similarity.

    A text is sent with its partners in parts of about PART_TEXTS, so that no task gets all partners
    of one. Up to BROADCAST_IDS wanted texts are picked out where they are read; beyond, by a shuffle.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_TEXTS).cast("int").alias("parts"))
    dealt = kept(pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("id")), "dealt")
    wanted = kept(dealt.unionByName(dealt.select("a", "part", F.col("a").alias("id")).distinct()), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(wanted) if few else wanted, "id").select("a", "part", "id", "_text")
    if repeats:
        rows = rows.dropDuplicates(["a", "part", "id"])

    def compare(group: pa.Table) -> pa.Table:
        sets = [(i, shingle_set(_words(t or b""), words)) for i, t in zip(group["id"].to_pylist(), group["_text"].cast(pa.large_binary()).to_pylist(), strict=True)]
        a = group["a"][0].as_py()
        heads, near = [g for i, g in sets if i == a], []
        for i, g in sets:
            for h in heads if i != a else []:
                both = len(np.intersect1d(g, h, assume_unique=True))
                if both >= similarity * (len(g) + len(h) - both) - 1e-9:
                    near.append(i)
                    break
        return pa.table([pa.array([a] * len(near), pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])

    return kept(rows.groupBy("a", "part").applyInArrow(compare, "a long, b long"), "verified")


def near_copy_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of df: key, component_id, for near copies by the similarity of word shingles.

    Texts are alike if the Jaccard similarity of their sets of `words`-word shingles (64-bit hashes) is
    at least `similarity`. Candidates are verified on the whole texts. Texts with a whole segment in
    common are linked first, so that of a large group of copies one text is left; the Golay keys of
    those that are left are joined and link nearly all others. Then sets in different components that
    share one of their rarest shingles are verified too (_rare_shingle_pairs), which is exact: no two
    texts that are alike stay in different components.

    A text meets only the least members of its buckets, so rows stay in proportion to the texts,
    however large a bucket; what that leaves apart, the exact join finds.

    Texts with equal shingle sets, among them those without words (null, empty, blank), are one node.
    component_id is the least key reached. An empty table gives no rows; null keys are rows without a
    component unless an equal text has a key; rows of one key are one document, whatever their texts;
    repeated rows keep their own row. Only the columns named are read.
    """
    spark, paths = df.sparkSession, []

    def kept(frame: DataFrame, name: str) -> DataFrame:
        paths.append(shared_folder(spark, name))
        frame.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("_text"))
    sketches = kept(_sketches(docs, words), "sketches")
    known = sketches.where("id is not null")
    repeats = not known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    nodes = kept(sketches.groupBy("same").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "lo", "hi", "least"))).alias("x"), F.count(F.lit(1)).alias("n")).select("same", "n", F.col("x.id").alias("node"), "x.lo", "x.hi", "x.least"), "nodes")
    named = nodes.where("node is not null").select("same", "node", "lo", "hi", "least")
    alike = lambda pairs: verified(kept(pairs, "candidates"), docs, words, similarity, repeats, kept)
    comp = lambda found: F.coalesce("component", "node").alias(found)
    edges = alike(_segment_pairs(named, kept))
    heads = named.join(components(edges), "node", "left").where("component is null or component = node").select(*named.columns)
    edges = edges.unionByName(alike(_golay_pairs(kept(heads, "heads"), kept)))
    first = kept(named.select("same", "node").join(components(edges), "node", "left").select("same", "node", comp("comp")), "first")
    edges = edges.unionByName(alike(_rare_shingle_pairs(docs, first, words, similarity, kept)))
    last = kept(nodes.select("same", "n", "node").join(components(edges), "node", "left").select("same", "n", comp("component_id")), "named")
    out = stored(lookup(sketches.select(F.col("id").alias(key), "same"), last, "same", "n").select(key, "component_id"), "near-copy-groups")
    for path in paths:
        remove_folder(spark, path)
    return out


def _rarity(docs: DataFrame, words: int) -> np.ndarray:
    """For each cell of shingle hashes, a class that grows with the shingles in it: 4 MB at any size.

    Any order of the shingles gives the same pairs; this one keeps common ones out of the prefixes.
    """
    size, lines = 1 << CELL_BITS, 1 << (CELL_BITS - 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, dtype=np.int32)
        for b in batches:
            for t in texts(b, "_text"):
                cells[(shingle_set(_words(t), words) >> np.uint64(64 - CELL_BITS)).astype(np.int64)] += 1
        part = cells.reshape(lines, -1)
        at = np.flatnonzero(part.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([part[i].astype("<i4").tobytes() for i in at], pa.binary())], names=["line", "cells"])

    def add(line: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // lines, dtype=np.int64)
        for b in batches:
            for c in b.column("cells").to_pylist():
                total += np.frombuffer(c, dtype="<i4")
        yield pa.RecordBatch.from_arrays([pa.array([line[0].as_py()]), pa.array([(8 * np.log2(1 + total)).astype(np.uint8).tobytes()], pa.binary())], names=["line", "cells"])

    out = np.zeros((lines, size // lines), dtype=np.uint8)
    for r in docs.select("_text").mapInArrow(count, "line long, cells binary").groupBy("line").applyInArrow(add, "line long, cells binary").toLocalIterator():
        out[r.line] = np.frombuffer(r.cells, dtype=np.uint8)
    return out.ravel()


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Rows (gram, same, size, at, salt): the first shingles of each set, rare ones first, `at` the place.

    A set of n can do without the others: if none of n - ceil(similarity n) + 1 is in another set,
    less than similarity n are. Equal sets of a task give their rows once. Rows of a shingle that may be
    frequent have one of SALTS salts, by their set, all others have none.
    """
    rarity = _rarity(docs, words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            got = []
            for t in texts(b, "_text"):
                g = shingle_set(_words(t), words)
                same = xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63)
                if not len(g) or same in seen:
                    continue
                seen.add(same)
                if len(seen) > KNOWN:
                    seen.clear()
                take = len(g) - math.ceil(similarity * len(g) - 1e-9) + 1
                rank = rarity[(g >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                first = np.argsort(rank, kind="stable")[:take]
                got.append((g[first], same, len(g), np.where(rank[first] >= FREQUENT, 1 + same % SALTS, 0)))
            takes = [len(x[0]) for x in got]
            grams = np.concatenate([*(x[0] for x in got), np.empty(0, dtype=np.uint64)]).view(np.int64)
            salt = np.concatenate([*(x[3] for x in got), np.empty(0, dtype=np.int64)]).astype(np.int32)
            at = np.concatenate([*map(np.arange, takes), np.empty(0, dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(np.array([x[1] for x in got], dtype=np.int64), takes)), pa.array(np.repeat(np.array([x[2] for x in got], dtype=np.int32), takes)), pa.array(at), pa.array(salt)], names=["gram", "same", "size", "at", "salt"])

    return docs.select("_text").mapInArrow(cut, "gram long, same long, size int, at int, salt int")


def _rare_shingle_pairs(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, kept) -> DataFrame:
    """Pairs (a, b) of nodes in different components `comp`, among them all of this similarity or more.

    Sets that are alike share a shingle of their prefixes, and the first that they share leaves enough
    places behind it in both. Under each shingle the members of its most frequent component, which are
    linked already, meet the other members only; a shingle of one component makes no pair. Members of
    frequent shingles are dealt over salted parts, so that no task gets all pairs of one.

    Sizes and places are in the key of the join: two sets of sizes s and t have at least
    (s + t) * similarity / (1 + similarity) shingles in common, and at place p of the first no more than
    s - p are left. That bounds t, and a member meets the bands of such sizes only. So texts of one
    template that differ in too much else do not meet, though they share many shingles.
    """
    rows = _prefixes(docs, words, similarity).repartition("gram", "salt").dropDuplicates(["gram", "salt", "same"])
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram", "salt"))).where("n > 1 or salt > 0").drop("n", "salt")
    rows = kept(rows.join(nodes, "same").select("gram", "node", "size", "at", "comp"), "prefixes")
    most = rows.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("gram")
    most = most.agg(F.max_by("comp", "n").alias("top"), F.count(F.lit(1)).alias("k"), F.ceil(F.sum("n") / SALT_ROWS).cast("int").alias("parts")).where("k > 1").drop("k")
    once = (F.col("comp2") == F.col("top")) | (F.col("node") < F.col("node2"))
    sizes = F.least("size", "size2") >= similarity * F.greatest("size", "size2") - 1e-9
    places = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) >= similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - 1e-9
    met = _met(kept(rows.join(most, "gram"), "open"), similarity).where((F.col("comp") != F.col("comp2")) & once & sizes & places)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs of rows (gram, node, size, at, comp, top, parts) that the join tries: those of bands that may fit."""
    band = lambda n: F.floor(F.round(F.log(n) / math.log(BAND), 9)).cast("int")
    right = rows.select("gram", band(F.col("size")).alias("band"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), *(F.col(c).alias(c + "2") for c in ("node", "size", "at", "comp")))
    least = F.greatest(similarity * F.col("size") - 1e-6, F.lit(1.0))
    most = F.least(F.col("size") / similarity, (1 + similarity) / similarity * (F.col("size") - F.col("at")) - F.col("size")) + 1e-6
    left = rows.where("comp <> top").withColumn("least", least).withColumn("most", most).where("most >= least")
    left = left.withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.col("most"))))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return left.join(right, ["gram", "part", "band"])
