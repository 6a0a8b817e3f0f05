"""Quality rules: text statistics, and a hashed n-gram likelihood ratio of trusted text against the corpus.

Byte n-grams are hashed into a fixed number of buckets. Two multinomials over the buckets, one of
trusted documents and one of all documents, give each text its log-likelihood ratio, divided by its
number of n-grams. One threshold holds for every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, row_without, table, texts

#: Buckets, orders of the byte n-grams, added to each bucket's count, and the least mean log ratio kept.
BUCKETS, ORDERS, SMOOTH, LEAST = 1 << 16, (3, 5), 0.5, -0.25
#: The target is learned from at most so many trusted rows, those with the least hash of their id.
TRUSTED = 50_000
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))


def gram_buckets(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each byte n-gram of a text; a text shorter than the least order has none."""
    a, out = np.frombuffer(text, dtype=np.uint8), []
    for n in ORDERS:
        if len(a) >= n:
            h = np.full(len(a) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h << np.uint64(8)) | a[k : len(a) - n + 1 + k]
            out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (buckets - 1))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    w = text.split()
    chars = len(b"".join(w).decode())
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = 0
    if len(windows) < len(w) - 2:
        last = 0  # words before this position are counted
        for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
            if windows[x] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return len(w), chars, symbols, dup, repeated


def fit_ratio(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket: trusted multinomial over corpus multinomial, counts of all rows.

    `trusted` has the ids of the target; at most TRUSTED of them are used, so that they may be
    broadcast. Each task sends at most one row per bucket and the driver gets one per bucket.
    """
    few = trusted.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(TRUSTED).withColumn("_good", F.lit(True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for t, good in zip(texts(b, "_text"), b.column(1).to_pylist(), strict=True):
                c = np.bincount(gram_buckets(t, buckets), minlength=buckets) if len(t) > 20_000 else None
                for total in (raw, target) if good else (raw,):
                    if c is None:
                        np.add.at(total, gram_buckets(t, buckets), 1)
                    else:
                        total += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(few), key, "left").select("_text", F.coalesce("_good", F.lit(False)).alias("_good"))
    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    for r in sums:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def judge_quality(df: DataFrame, ratio: np.ndarray, text: str = "text", least: float = LEAST) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, mean_ratio, kept.

    Null texts count as empty: no words, base_failed. A text without n-grams has ratio 0. Columns of
    df with those names are replaced; repeated rows are judged alike.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(s: pa.Array) -> pa.Array:
        many = [t or b"" for t in s.cast(pa.large_binary()).to_pylist()]
        stats = np.array([text_stats(t) for t in many], dtype=np.int64).reshape(-1, 5)
        mean = np.array([round(float(ratio[g].mean()), 6) if len(g := gram_buckets(t, len(ratio))) else 0.0 for t in many], dtype=float)
        return pa.StructArray.from_arrays([*(pa.array(stats[:, i].copy()) for i in range(5)), pa.array(mean)], names=[*names, "mean_ratio"])

    udf = F.arrow_udf(judge, ", ".join(f"{n} long" for n in names) + ", mean_ratio double")
    new = (*names, "base_failed", "mean_ratio", "kept")
    failed = (F.col("q.n_words") < 50) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))
    out = df.select(row_without(df, *new).alias("row"), udf(F.col(text).cast("string")).alias("q"))
    return out.select(*columns_of(df, *new), "q.*", failed.alias("base_failed"), (~failed & (F.col("q.mean_ratio") >= least)).alias("kept"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judge_quality(docs, fit_ratio(docs, trusted)).drop("text")
