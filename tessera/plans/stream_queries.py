"""Streaming ingest over events, read as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import ingest

from .merge_queries import scratch
from .registry import query, table


def _stream(spark, sf_dir, twice=False):
    """The events table as a stream: its files are read by Spark's file source; `twice`: every event comes again."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(_folder(spark, sf_dir, twice)).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark, sf_dir, twice=False):
    """Events copied to a folder of their own: a stream reads folders, and the table may be one file."""
    path = scratch(spark, "events")
    table(spark, sf_dir, "events").write.parquet(path)
    if twice:
        table(spark, sf_dir, "events").write.mode("append").parquet(path)
    return path


@query("SELECT event_type, status, count(*) AS n, 1 AS n_kinds FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 2 ELSE 0 END AS status FROM events) GROUP BY 1, 2")
def ingest_runs(spark, sf_dir):
    """Events that come twice, in several batches and in no order of time: each is one run, and each kind one row of its dimension."""
    path = scratch(spark, "ingest")
    runs = _stream(spark, sf_dir, twice=True).select(F.col("event_id").alias("run_id"), "ts", "event_type", F.when(F.col("event_type") == "error", "ShaderResultInconsistencyException").alias("message"))
    ingest.ingest(runs, path, {"kind": ["event_type"]}, f"{path}/checkpoint").awaitTermination()
    got, kinds = spark.read.parquet(f"{path}/run"), spark.read.parquet(f"{path}/kind").groupBy("kind_id", "event_type").agg(F.count(F.lit(1)).alias("n_kinds"))
    return got.join(kinds, "kind_id").groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.max("n_kinds").alias("n_kinds"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ingest_counts(spark, sf_dir):
    path = scratch(spark, "counts")
    counts = ingest.status_counts(_stream(spark, sf_dir), "ts", "1 day", "event_type", "1 hour")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, 2 * count(*) AS n FROM events GROUP BY 1, 2")
def ingest_count_updates(spark, sf_dir):
    """Events that come twice, in several batches: each batch changes counts, and the last ones stand."""
    path = scratch(spark, "count-updates")
    counts = ingest.status_counts(_stream(spark, sf_dir, twice=True), "ts", "1 day", "event_type", "10000 days")
    ingest.store_counts(counts, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return ingest.stored_counts(spark, f"{path}/out", "event_type")


@query("SELECT event_id, value AS trace, event_type = 'click' AS hash_mismatch FROM events WHERE user_id % 2 = 0")
def ingest_traces(spark, sf_dir):
    """Traces that come as a stream are attached to the stored runs; clicks have another image."""
    path = scratch(spark, "traces")
    table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("hash"), F.lit(None).cast("double").alias("trace")).write.parquet(f"{path}/runs")
    traces = _stream(spark, sf_dir).where("user_id % 2 = 0").select("event_id", F.col("value").alias("trace"), F.when(F.col("event_type") == "click", "other").otherwise(F.col("event_type")).alias("hash"))
    ingest.attach_stream(traces, f"{path}/runs", f"{path}/out", f"{path}/checkpoint", "event_id", "trace", "hash").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "trace", "hash_mismatch")
