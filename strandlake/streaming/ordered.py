"""Ordered streams: records that come nearly in order leave in order, and what comes too late is an error.

Of each key a window of positions behind the newest one is held in state; what lies behind it leaves, sorted, with its place. A record that
belongs before one that has left already cannot be put in order any more: it stops the query with an error instead of being dropped. State is a list
(the held records) and a value (newest position, last one that left, how many have left); both are restored from the checkpoint when the
query goes on. What is still held when a bounded stream ends is read from the checkpoint (`held`), or leaves by a timer after `idle`
milliseconds without a record of its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from strandlake.session import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Late(ValueError):
    """A record that comes after others have left that it belongs before."""


class HoldWindow(StatefulProcessor):
    def __init__(self, schema: T.StructType, at: str, ties: list[str], width: int, idle: int | None):
        self.schema, self.at, self.order, self.width, self.idle = schema, at, [at, *ties], width, idle
        self.names = schema.names

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.seen = handle.getValueState("seen", "newest bigint, left_at bigint, left_n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[self.names]
        newest, left_at, left_n = self.seen.get() if self.seen.exists() else (None, None, 0)
        first = int(new[self.at].min())
        if left_at is not None and first < left_at:
            raise Late(f"record of {key} at {first} comes after {left_at} has left")
        old = pd.DataFrame(list(self.held.get()), columns=self.names) if self.held.exists() else new.iloc[:0]
        both = pd.concat([old.astype(new.dtypes.to_dict()), new], ignore_index=True) if len(old) else new
        newest = max(int(new[self.at].max()), newest if newest is not None else int(new[self.at].max()))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self.out(both, both[self.at] < newest - self.width, newest, left_at, left_n)

    def out(self, rows: pd.DataFrame, leaves, newest: int, left_at: int | None, left_n: int) -> pd.DataFrame:
        gone, stay = rows[leaves].sort_values(self.order, kind="stable", ignore_index=True), rows[~leaves]
        if len(stay):
            self.held.put([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in stay.itertuples(index=False)])
        else:
            self.held.clear()
        if len(gone):
            left_at = int(gone[self.at].iloc[-1])
        self.seen.update((newest, left_at, left_n + len(gone)))
        gone["place"] = range(left_n + 1, left_n + len(gone) + 1)
        return gone

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            rows = pd.DataFrame(list(self.held.get()), columns=self.names)
            newest, left_at, left_n = self.seen.get()
            yield self.out(rows, rows[self.at] == rows[self.at], newest, left_at, left_n)

    def close(self) -> None:
        pass


def in_order(df: DataFrame, keys: list[str], at: str, width: int = 1000, ties: tuple[str, ...] = (), idle: int | None = None) -> DataFrame:
    """The records of a stream of each key in order of `at` (then `ties`), with place, their number in that order. width: how far behind the
    newest record of its key one may come. Rows without a position are left out; those with a null key are a key of their own."""
    df = df.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("long"))
    schema = T.StructType(df.schema.fields)
    df.sparkSession.conf.set(PROVIDER, ROCKS)
    out = T.StructType([*schema.fields, T.StructField("place", T.LongType())])
    hold = HoldWindow(schema, at, list(ties), width, idle)
    return df.groupBy(*keys).transformWithStateInPandas(hold, out, "Append", "ProcessingTime" if idle is not None else "None")


def held(spark: SparkSession, checkpoint: str, keys: list[str], at: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """What in_order still holds at a checkpoint, with the places that it will have."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    rows = read("held").option("flattenCollectionTypes", "true").load()
    rows = rows.select(F.col("list_element.*"))
    left = read("seen").load().select(*(F.col(f"key.{k}").alias(f"_{i}") for i, k in enumerate(keys)), F.col("value.left_n").alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(F.col(f"_{i}"))
    w = Window.partitionBy(*keys).orderBy(at, *ties)  # a window's width of a key at most
    return rows.join(left, same).withColumn("place", F.col("_n") + F.row_number().over(w)).drop("_n", *(f"_{i}" for i in range(len(keys))))


def run_in_order(df: DataFrame, keys: list[str], at: str, width: int = 1000, ties: tuple[str, ...] = (), checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Feeds what a stream has now through in_order: what has left, and what is still held. Given the same checkpoint and folder again, it goes
    on where it stopped."""
    spark = df.sparkSession
    checkpoint, out = checkpoint or scratch_path(spark, "stream-state"), out or scratch_path(spark, "stream")
    ordered = in_order(df, keys, at, width, ties)
    q = ordered.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(ordered.schema).parquet(out).unionByName(held(spark, checkpoint, keys, at, ties))


def arriving(df: DataFrame, order: F.Column, parts: int, files: int = 4) -> DataFrame:
    """A table as a stream in `parts` triggers: its rows by a number from 0 to parts - 1, a fixed number of files each, written one
    part after the other."""
    path = scratch_path(df.sparkSession, "arriving")
    x = df.withColumn("_part", order)
    for k in range(parts):
        x.filter(F.col("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
