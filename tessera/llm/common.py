"""What several operators share: words, inputs, the shared folder, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordinal import shared_base

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text; bytes.split() parts at those bytes alone."""
    return text.split()


def row_without(df: DataFrame, *names: str) -> Column:
    """The row of df as one struct, without the columns of these names in either case.

    Operators carry it as `row` beside their own columns, so that no name of df can clash with one of
    theirs; `columns_of` takes it apart again.
    """
    return F.struct(*[F.col(f"`{c}`") for c in _rest(df, names)] or [F.lit(0).alias("nothing")])


def columns_of(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df without these names, out of the struct `row` that row_without made of it."""
    return [F.col("row")[c].alias(c) for c in _rest(df, names)]


def _rest(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def beside(df: DataFrame, new: Column, *names: str) -> DataFrame:
    """df with the fields `names` of the struct column `new`; columns of df with those names are replaced."""
    return df.select(row_without(df, *names).alias("row"), new.alias("new")).select(*columns_of(df, *names), *[f"new.{n}" for n in names])


_WORD_HASHES: dict[bytes, int] = {}


def word_hashes(many: list[bytes]) -> np.ndarray:
    """XXH64 (seed 7) of each word as unsigned 64-bit; a memory of up to 100,000 words spares repeats."""
    known = _WORD_HASHES
    if len(known) > 100_000:
        known.clear()
    for w in many:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 7)
    return np.fromiter(map(known.__getitem__, many), dtype=np.uint64, count=len(many))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: Rows of a batch of texts that Spark sends to Python: whole texts are long, and a task holds a few batches.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS, as jobs on long texts need."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor and the driver see."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Connected components of undirected long edges: rows (node, component), component the least node.

    Alternates large stars and small stars, each one aggregation and one join on narrow rows, and
    stores the edges after each round. The loop ends when a round changes nothing. Self edges and
    nulls are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    spark, before = edges.sparkSession, None
    paths = []
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.where("u <> v").distinct()
        down = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        paths.append(shared_folder(spark, "components"))
        small.select("x.u", "x.v").where("u <> v").distinct().write.parquet(paths[-1])
        e = spark.read.parquet(paths[-1])
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if len(paths) > 1:
            remove_folder(spark, paths.pop(0))
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("u")).distinct().join(star, "u", "left_anti").select("u", F.col("u").alias("component"))
    return star.unionByName(roots).withColumnRenamed("u", "node")


def lookup(big: DataFrame, small: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """big inner-joined to small on key, where small has one row per key and n, the key's rows in big.

    Keys with over a `share`-th of big's rows, of which there are fewer than `share`, are broadcast;
    the others are joined by a shuffle, in which no key stands out. n is dropped.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total / share
    if small.where(hot).isEmpty():
        return big.join(small.drop(n), key)
    often = F.broadcast(small.where(hot).drop(n))
    rare = small.where(~hot).drop(n)
    return big.join(often, key).unionByName(big.join(often.select(key), key, "left_anti").join(rare, key))


def crc32_sql(k: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the ASCII text in column k."""
    codes = f"list_transform(range(strlen({k})), lambda i: CAST(ascii(substr({k}, 1 + i, 1)) AS BIGINT))"
    step = "lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END"
    byte = f"lambda c, x: list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), {step})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {byte}), CAST(4294967295 AS BIGINT))"
