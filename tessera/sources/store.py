"""Reading and writing stores: base tables, nested documents, snapshots, packed columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schemas of the base tables, of the variant tree and of a document.
SCHEMAS = {
    "environment": "id long, node string, os string, cpu string, gpu string, gpu_driver string, comment string",
    "shader": "id long, shader_id string, fragment_spv binary",
    "resource": "id long, uniform_block binary",
    "trace": "id long, bb_idx_map string, bb_trace_counters string, traced_fragment_spv binary",
    "experiment": "id long, time timestamp_ntz, environment long, augmentation int, augmentation_annotation string, width int, height int, shader_shadertoy_id string, shader long, resource long, trace long, parent long, measurement int, image_hash string, num_cycles int, num_trials int, errors int, results string",
    "augmentation": "id long, augmentation int, augmentation_annotation string, fragment_spv binary, shader_id string, depth int, parent long, dis_from_last int, dis_ratio_from_last double, dis_from_origin int, dis_ratio_from_origin double",
}
DOCUMENT = "Error string, Shader struct<info:struct<name:string,username:string>,renderpass:array<struct<type:string,code:string,inputs:array<struct<id:string,src:string,ctype:string,channel:int>>,outputs:array<struct<id:string,channel:int>>>>>"
#: Fixed value: the layout of the packed uniform block, without padding.
UNIFORMS = [("iResolution", "<f4", (3,)), ("iTime", "<f4", ()), ("iChannelTime", "<f4", (4,)), ("iMouse", "<f4", (4,)), ("iDate", "<f4", (4,)), ("iSampleRate", "<f4", ()), ("iChannelResolution", "<f4", (16,)), ("iFrame", "<i4", ()), ("iTimeDelta", "<f4", ()), ("iFrameRate", "<f4", ())]


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again, for what is used more than once; Spark then knows its size."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A base table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def export_tables(tables: Mapping[str, tuple[DataFrame, str]], path: str, samples: int = 3) -> DataFrame:
    """Write each table (a frame and its key) below path; rows (name, rows, samples) of what was written.

    samples: the rows of least key as JSON, the feature of the report.
    """
    found = []
    for name, (df, key) in tables.items():
        df.write.parquet(f"{path}/{name}")
        back = df.sparkSession.read.parquet(f"{path}/{name}")
        few = back.orderBy(key).limit(samples).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(F.struct(*sorted(back.columns))).alias("j")))), lambda x: x["j"]).alias("samples"))
        found.append(back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")).join(F.broadcast(few)))  # one row each
    return reduce(DataFrame.unionByName, found)


def read_documents(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """Rows (id, document): nested JSON, a file each; the id is the file's name, before the first `-` if legacy.

    An id that two files have fails the job.
    """
    from .named import read_named

    docs = read_named(spark, path, DOCUMENT, legacy)
    return docs.select("id", F.struct("document.Error", "document.Shader").alias("document"))


def write_documents(docs: DataFrame, path: str, id: str = "id") -> None:
    """Documents in folders by the first two characters of the id."""
    docs.withColumn("c0", F.substring(id, 1, 1)).withColumn("c1", F.substring(id, 2, 1)).write.partitionBy("c0", "c1").json(path)


def read_split(spark: SparkSession, path: str, split: str, normalise: tuple[str, float, float] | None = None) -> DataFrame:
    """One split of a snapshot; `normalise`: (column, mean, stdev) for a z-score of it."""
    out = spark.read.parquet(path).where(F.col("split") == split)
    if normalise:
        col, mean, stdev = normalise
        out = out.withColumn(col, F.try_divide(F.col(col) - mean, F.lit(float(stdev))))
    return out


def combine(spark: SparkSession, shards: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Rows of (index, path, split) shards with datasetIdx and datasetSplit."""
    return reduce(DataFrame.unionByName, [read_split(spark, p, s).withColumn("datasetIdx", F.lit(i)).withColumn("datasetSplit", F.lit(s)) for i, p, s in shards])


def audit(df: DataFrame, by: str = "split") -> DataFrame:
    """Rows (split, n, checksum): a sum over rows' hashes, the same in any order, that repeated rows change."""
    cols = sorted(c for c in df.columns if c != by)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("checksum"))


def audit_problems(df: DataFrame, manifest: DataFrame, by: str = "split") -> DataFrame:
    """Splits whose count or checksum differs from the manifest's."""
    now = audit(df, by).withColumnRenamed("n", "_n").withColumnRenamed("checksum", "_c")
    return now.join(manifest, by, "full_outer").where(~(F.col("_n").eqNullSafe(F.col("n")) & F.col("_c").eqNullSafe(F.col("checksum")))).select(by)


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction pairs (sample_id, dataset, split, method, real, pred) by dataset and method."""
    df.write.partitionBy("dataset", "method").parquet(path)


def read_predictions(spark: SparkSession, path: str, dataset: str | None = None, method: str | None = None, split: str | None = None) -> DataFrame:
    """Stored prediction pairs, optionally of one data set, method or split; other folders are not read."""
    out = spark.read.parquet(path).withColumns({c: F.col(c).cast("string") for c in ("dataset", "method")})
    for col, value in (("dataset", dataset), ("method", method), ("split", split)):
        out = out if value is None else out.where(F.col(col) == value)
    return out


def unpack_struct(col: str, layout=UNIFORMS) -> Column:
    """A packed binary column as a struct of floats, ints and arrays; null if its length does not fit."""
    kind = np.dtype([(n, t, s) for n, t, s in layout])
    sql = {"f": "float", "i": "int", "u": "long"}
    fields = ", ".join(f"{n}: {'array<' if s else ''}{sql[np.dtype(t).kind]}{'>' if s else ''}" for n, t, s in layout)

    native = {"f": "<f4", "i": "<i4", "u": "<i8"}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            fits = pc.fill_null(pc.equal(pc.binary_length(b), kind.itemsize), False)
            blank = pa.scalar(bytes(kind.itemsize), b.type)
            rows = np.frombuffer(b"".join(pc.if_else(fits, b, blank).to_pylist()), dtype=kind)  # one buffer for all rows
            cols = []
            for n, t, s in layout:
                flat = pa.array(np.ascontiguousarray(rows[n]).astype(native[np.dtype(t).kind]).ravel())
                size = int(np.prod(s)) if s else 1
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, size * (len(rows) + 1), size, dtype=np.int32)), flat) if s else flat)
            yield pa.StructArray.from_arrays(cols, names=[n for n, _, _ in layout], mask=pc.invert(fits))

    return F.arrow_udf(run, f"struct<{fields}>")(F.col(col))


def unpack_counters(col: Column, width: int = 8) -> Column:
    """Packed little-endian unsigned counters of 4 or 8 bytes as decimals; bytes left over are dropped."""
    cells = F.regexp_extract_all(F.hex(col), F.lit(f"[0-9A-F]{{{2 * width}}}"), F.lit(0))  # cut once, in one pass
    swapped = lambda c: F.concat(*[F.substring(c, 2 * k + 1, 2) for k in reversed(range(width))])
    return F.transform(cells, lambda c: F.conv(swapped(c), 16, 10).cast("decimal(20,0)"))


def parse_trials(results: Column) -> Column:
    """A JSON array of numbers; the empty text, of failed runs, is null."""
    return F.when(results != "", F.from_json(results, "array<double>"))


def parse_counters(text: Column) -> Column:
    return F.from_json(text, "array<decimal(20,0)>")


def parse_block_map(text: Column) -> Column:
    """A JSON object with integers as text keys, as a map of integers."""
    return F.transform_keys(F.from_json(text, "map<string,int>"), lambda k, v: k.cast("int"))


def assemble_samples(experiments: DataFrame, shaders: DataFrame, traces: DataFrame) -> DataFrame:
    """Training samples of traced runs: programs, mean time, decoded block map and counters."""
    from tessera.operators.stats import array_mean

    s = shaders.select(F.col("id").alias("shader"), "shader_id", "fragment_spv")
    t = traces.select(F.col("id").alias("trace"), "bb_idx_map", "bb_trace_counters", "traced_fragment_spv")
    return experiments.join(s, "shader").join(t, "trace").select(F.col("environment").alias("environmentId"), F.col("shader_id").alias("shaderId"), F.col("fragment_spv").alias("fragSpv"), F.col("traced_fragment_spv").alias("traceFragSpv"), array_mean(parse_trials(F.col("results"))).alias("timeMean"), parse_block_map(F.col("bb_idx_map")).alias("bbIdxMap"), parse_counters(F.col("bb_trace_counters")).alias("bbTraceCounters"))
