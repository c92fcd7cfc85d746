"""Moving averages by numbers of rows and stretches of equal labels, over groups whose rows never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20  # positions of a tile
BLOCK = 1 << 15  # rows of a block


def moving_average(df: DataFrame, keys: list[str], at: str, value: str, before: int, after: int, name: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Adds `name`, the mean of value over the row, the `before` rows ahead of it and the `after` rows behind it, by position and group; fewer
    at the ends. Nulls do not count. Positions are unique in a group; null keys are a group.

    Rows are numbered by tiles of positions (a group's tiles, a number each, are what a window over the group sees) and averaged in blocks of row
    numbers, each with the few rows of its neighbours that it needs."""
    x = df.select("*", F.floor(F.col(at) / width).alias("_tile"))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_tile").orderBy(at)))
    tiles = x.groupBy(*keys, "_tile").agg(F.count("*").alias("_size"))
    tiles = tiles.withColumn("_past", F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tiles = tiles.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_tile").alias("_t"), "_past")
    same = F.col("_tile") == F.col("_t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    x = x.join(tiles, same).withColumn("_row", F.col("_past") + F.col("_n") - 1)
    size = max(block, before + after)
    in_block = lambda r: F.floor(r / size)
    x = x.withColumn("_own", in_block(F.col("_row")))
    x = x.withColumn("_block", F.explode(F.array_distinct(F.array(in_block(F.col("_row") - after), F.col("_own"), in_block(F.col("_row") + before)))))
    x = x.withColumn(name, F.avg(value).over(Window.partitionBy(*keys, "_block").orderBy("_row").rowsBetween(-before, after)))
    return x.filter("_block = _own").select(*df.columns, name)


def stretches(df: DataFrame, keys: list[str], at: str, labels: list[str], sums: dict[str, str], width: int = WIDTH) -> DataFrame:
    """keys, labels, beg, end, sites and the sums (name: column) of unbroken stretches of equal labels; nulls are equal. Found within
    tiles of positions and put together over their edges."""
    x = df.select(*keys, at, *labels, *(F.col(c).alias(f"_{n}") for n, c in sums.items()), F.floor(F.col(at) / width).alias("_tile"))
    fresh = lambda w: F.coalesce((~F.struct(*labels).eqNullSafe(F.lag(F.struct(*labels)).over(w))).cast("int"), F.lit(1))
    w = Window.partitionBy(*keys, "_tile").orderBy(at)
    x = x.withColumn("_new", fresh(w)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = x.groupBy(*keys, "_tile", "_run", *labels).agg(F.min(at).alias("beg"), F.max(at).alias("end"), F.count("*").alias("sites"), *(F.sum(f"_{n}").alias(n) for n in sums))
    w = Window.partitionBy(*keys).orderBy("beg")  # a row a stretch of a tile
    part = part.drop("_run").withColumn("_new", fresh(w)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = part.groupBy(*keys, "_run", *labels).agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.sum("sites").alias("sites"), *(F.sum(n).alias(n) for n in sums))
    return out.drop("_run")
