"""Set operators over keyed tables: presence masks, ordered union, dedup, scatter, column-wise merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import scratch_path

MERGE = {
    "sum": lambda c: F.sum(F.coalesce(c, F.lit(0))), "avg": lambda c: F.sum(F.coalesce(c, F.lit(0))) / F.count(F.lit(1)),
    "min": F.min, "max": F.max, "join": lambda c: F.array_join(F.array_sort(F.collect_list(c.cast("string"))), ","),
    "unique": lambda c: F.array_join(F.array_sort(F.collect_set(c.cast("string"))), ","),
}
# rules that go by the order of the rows; the first and the distinct ones do not count missing values
ORDERED = {
    "first": lambda c, o: F.min_by(c, F.when(c.isNotNull(), o)),
    "append": lambda c, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(o.alias("o"), c.cast("string").alias("v"))))), lambda x: x["v"]), ","),
    "append-missing": lambda c, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.coalesce(c.cast("string"), F.lit(".")).alias("v")))), lambda x: x["v"]), ","),
    "distinct": lambda c, o: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(o.alias("o"), c.cast("string").alias("v"))))), lambda x: x["v"])), ","),
}


def presence(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, bits ("0101": in which sources), n: one row per distinct key. One shuffle whatever the number of sources, of which
    there can be 63 (the bits of a long)."""
    if len(sources) > 63:
        raise ValueError("presence masks hold up to 63 sources")
    both = reduce(DataFrame.unionByName, [s.select(*keys, F.lit(1 << i).cast("long").alias("_bit")) for i, s in enumerate(sources)])
    k = len(sources)
    g = both.groupBy(*keys).agg(F.bit_or("_bit").alias("_mask"))
    return g.select(*keys, F.reverse(F.lpad(F.bin("_mask"), k, "0")).alias("bits"), F.bit_count("_mask").alias("n"))


def isec(sources: list[DataFrame], keys: list[str], op: str) -> DataFrame:
    """Keys by presence: "=N" in just N sources, "+N" in N or more, "-N" in N or fewer, "~1010" in just these."""
    p = presence(sources, keys)
    kind, want = op[0], op[1:]
    return p.filter({"=": lambda: F.col("n") == int(want), "+": lambda: F.col("n") >= int(want), "-": lambda: F.col("n") <= int(want), "~": lambda: F.col("bits") == want}[kind]())


def complement(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source whose key no other has."""
    rest = reduce(DataFrame.unionByName, [s.select(*keys) for s in sources[1:]])
    return sources[0].join(rest, keys, "left_anti")


def first_of(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def concat(sources: list[DataFrame], keys: list[str] | None = None, *order: Column) -> DataFrame:
    """All rows of all sources; with keys, of equal keys the row of the earliest source."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)])
    return first_of(both, [F.col(k) for k in keys], F.col("src"), *order) if keys else both


def scatter(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Adds chunk: rows in order, n to a chunk. Ranks go through range partitions, so no task sees all rows. The partitions are
    written once with their numbers and read again: numbers given in two runs of a plan need not agree."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    path = scratch_path(spark, "scatter")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = placed.groupBy("_p").count()  # a row for each range partition
    base = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_base"))
    return placed.join(F.broadcast(base), "_p").withColumn("chunk", F.floor((F.col("_base") + F.col("_i")) / n)).drop("_p", "_i", "_base")


def merge_rows(sources: list[DataFrame], keys: list[str], rules: dict[str, str], order: list[str] = ()) -> DataFrame:
    """One row per key with every field merged by its rule: sum, avg (missing counts as 0, over contributing rows), min, max,
    join and unique (by value), or in the order of the sources and then of the columns `order`: first, append, append-missing,
    distinct. Rows that tie are taken by value."""
    each = [s.select(*keys, *dict.fromkeys([*rules, *order]), F.lit(i).alias("_source")) for i, s in enumerate(sources)]
    place = F.struct("_source", *order)
    both = reduce(DataFrame.unionByName, each)
    name = lambda c, r: f"{c}_{r.replace('-', '_')}"
    return both.groupBy(*keys).agg(*((ORDERED[r](F.col(c), F.struct(place, F.col(c))) if r in ORDERED else MERGE[r](F.col(c))).alias(name(c, r)) for c, r in rules.items()))


def outer_columns(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables side by side, keys of either kept."""
    return a.join(b, keys, "full_outer")


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def edit_distances(df: DataFrame, keys: list[str], row: str, text: str, parts: int, block: int = 256) -> DataFrame:
    """x, y, d: pairs of rows of equal keys, x < y, with the edit distance of their texts (null where one has none). Equal texts are one class: each
    text gets its distances to all texts of its keys once, as arrays of up to `block` numbers in the order of texts, and a pair only looks its
    distance up. parts: in how many partitions rows are dealt, as pairs are many more than rows."""
    names = df.select(*keys, F.col(text).alias("_tb")).distinct().repartition(parts, *keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_tb")) - 1
    to = names.withColumn("_n", number).select(*keys, "_tb", F.floor(F.col("_n") / block).alias("_block"), (F.col("_n") % block).alias("_at"))
    each = names.withColumnRenamed("_tb", "_ta").join(to, keys).select(*keys, "_ta", "_block", F.struct("_at", F.levenshtein("_ta", "_tb").alias("d")).alias("_d"))
    apart = each.groupBy(*keys, "_ta", "_block").agg(F.transform(F.array_sort(F.collect_list("_d")), lambda p: p["d"]).alias("_d"))

    def met(name: str, classes: DataFrame, own: str) -> DataFrame:
        rows = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(row).alias(name), F.col(text).alias("_t"))
        same = F.col("_t").eqNullSafe(F.col(own))
        for i, k in enumerate(keys):
            same = same & (F.col(f"_k{i}") == F.col(k))
        return rows.join(classes, same).drop("_t", own, *(f"_k{i}" for i in range(len(keys)))).repartition(parts, *keys, "_block")

    return met("x", apart, "_ta").join(met("y", to, "_tb"), [*keys, "_block"]).filter("x < y").select("x", "y", F.get("_d", F.col("_at")).alias("d"))
