"""Streaming ingest of run outcomes: each run once, dimensions by content, counts by status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.operators.filters import error_number


def content_id(*cols: str) -> Column:
    """An id that is a hash of the natural key, so that a batch that is written again gives it again."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def once(runs: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Runs without repeats of a key within the watermark."""
    return runs.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def ingest(runs: DataFrame, path: str, dimensions: dict[str, Sequence[str]], checkpoint: str, message: str = "message", key: str = "run_id"):
    """Start a query that appends runs, with a status, and the dimension rows that they bring.

    A batch is written to a folder of its number, so that a batch that is tried again replaces what
    it left. Runs are told by their key, dimension rows by content ids, and a batch writes those that no
    other batch has written (get or create): each is there once, however many batches bring it and
    however late. A batch and its de-duplication run once, for all tables.
    """
    spark = runs.sparkSession
    drop = [c for cols in dimensions.values() for c in cols]

    def shaped(df: DataFrame) -> DataFrame:
        out = df.withColumn("status", error_number(F.col(message)))
        for name, cols in dimensions.items():
            out = out.withColumn(f"{name}_id", content_id(*cols))
        return out

    def others(session: SparkSession, name: str, id: str, number: int) -> DataFrame:
        """The ids that other batches have written."""
        return session.read.parquet(f"{path}/{name}").where(F.col("batch") != number).select(F.col(id).alias("_known"))

    shaped(spark.createDataFrame([], runs.schema)).drop(*drop, message).write.mode("ignore").parquet(f"{path}/run/batch=-1")
    for name, cols in dimensions.items():  # what is read before the first batch
        kind = StructType([StructField(f"{name}_id", StringType()), *(runs.schema[c] for c in cols)])
        spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{path}/{name}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        known = others(batch.sparkSession, "run", key, number)
        out = shaped(batch.dropDuplicates([key])).join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti").persist()
        try:
            for name, cols in dimensions.items():
                known = others(batch.sparkSession, name, f"{name}_id", number)
                new = out.select(f"{name}_id", *cols).distinct().join(known, F.col(f"{name}_id") == F.col("_known"), "left_anti")
                new.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            out.drop(*drop, message).write.mode("overwrite").parquet(f"{path}/run/batch={number}")
        finally:
            out.unpersist()

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(runs: DataFrame, time: str, window: str, status: str, late: str) -> DataFrame:
    """Rows (start, status, n) by event-time windows."""
    w = runs.withWatermark(time, late).groupBy(F.window(time, window), status).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), status, "n")


def store_counts(counts: DataFrame, out: str, checkpoint: str):
    """Start a query that writes the counts that each batch changes, in update mode, to a folder of its number.

    State stays bounded: a window that the watermark has passed is dropped, and rows later than that
    are not counted.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_counts(spark: SparkSession, out: str, status: str) -> DataFrame:
    """Rows (start, status, n): the last count of each window that any batch has written."""
    return spark.read.parquet(out).groupBy("start", status).agg(F.max_by("n", "batch").alias("n"))


def attach_stream(traces: DataFrame, target: str, out: str, checkpoint: str, key: str, value: str, hash_col: str):
    """Start a query that joins each batch of traces to the stored runs and writes the attached rows."""
    from tessera.operators.merge import attach

    def write(batch: DataFrame, number: int) -> None:
        runs = batch.sparkSession.read.parquet(target)
        attach(runs.join(batch.select(key), key, "left_semi"), batch, key, value, hash_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return traces.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
