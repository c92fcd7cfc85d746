"""Structured Streaming: tumbling, sliding and session windows, watermarked dedup, and order-checked flushing.

Each takes a streaming DataFrame and gives one; `run_to_end` feeds a file source until it is empty and returns what was
written, so batch and stream results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import scratch_path


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table as a stream. A table is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    times = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path if _is_folder(spark, path) else f"{sf_dir}/{name}.parquet*")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in times})  # watermarks want an instant


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tumbling(df: DataFrame, at: str, width: str, *keys: str, delay: str = "0 seconds") -> DataFrame:
    g = df.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("beg"), *keys, "n", "total")


def sliding(df: DataFrame, at: str, width: str, slide: str, *keys: str, delay: str = "0 seconds") -> DataFrame:
    g = df.withWatermark(at, delay).groupBy(F.window(at, width, slide), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("beg"), *keys, "n")


def sessions(df: DataFrame, at: str, gap: str, *keys: str, delay: str = "0 seconds") -> DataFrame:
    g = df.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("beg"), F.col("session_window.end").alias("end"), *keys, "n")


def dedup(df: DataFrame, at: str, *keys: str, delay: str = "30 days") -> DataFrame:
    """First rows by keys; those of a key that are further apart than the delay are told apart again, so state goes with the watermark."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_end(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All output of a streaming DataFrame over the data that is there now, as a batch DataFrame. Results go to a table in the
    shared folder, batch by batch; in complete mode each batch replaces the one before."""
    spark = df.sparkSession
    out = scratch_path(spark, "stream")

    def sink(batch: DataFrame, k: int) -> None:
        # a batch that is tried again overwrites what it had written
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={k}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out) if mode == "complete" else spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(out).drop("batch")
