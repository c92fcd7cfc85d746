"""Connected components of a table of links, distributed.

Large-star and small-star steps in turn (each node's greater neighbours, then its smaller ones, are tied to the least in
reach) until nothing changes; every step is map-side combined aggregation and a join, and a table in the shared folder, so a
hub with any number of links is no single task's burden and lost executors cost one step. Tables and shuffle files of a step go when
the next is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import remove, written


def _star(e: DataFrame, ends: DataFrame, small: bool) -> tuple[DataFrame, list[str]]:
    """Links (u, v) after a step, and the tables behind them. ends: the links that nodes look at, as (u, v)."""
    spark = e.sparkSession
    # a table of its own: joined from an aggregate in the same stage, a hub's rows could not be split over tasks
    least, path = written(spark, ends.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    if small:
        rest = ends.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    else:
        least = least.withColumn("m", F.least("u", "m"))
        out = ends.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out, out_path = written(spark, out, "components-links")
    return out, [path, out_path]


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, label: the least node in reach of each node of links (a, b). Nodes without links are not listed, and neither
    are the least nodes themselves."""
    e, path = written(spark, links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components-links")
    state = None
    while True:
        new = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if new == state or not new[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = new
        large, large_paths = _star(e, e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), False)
        remove(spark, path)
        e, paths = _star(large, large, True)
        path = paths.pop()
        remove(spark, *large_paths, *paths)
