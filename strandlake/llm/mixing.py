"""Mixing sources to target weights (operator 1).

Slot i of the schedule is the point frac(i / golden ratio) mapped through the cumulative targets of the sources, so every
stretch of slots holds each source in proportion. The documents of a source are shuffled by a hash and laid end to end as a
stream of words, cut into blocks of equal length; a source's slot of rank r takes block r, going round as often as needed.
The schedule is cut, or topped up by the few slots that low discrepancy leaves out, so that a source gives its target to a
word.

Everything is DataFrame work. Running sums over a source go through hash buckets (sums inside buckets, of buckets in groups of
2**FAN, and of groups), and ranks of slots through chunks of the schedule, so no source, however large, meets in one task.

Defined results: a null text has size 0; the null source is a source of its own, after all others; a source without words
has target 0; documents without words take nothing; an empty table gives none; repeated rows each take their own words.
A null id is an id like any other; very long texts are laid over as many blocks as they fill; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import free, hashed, n_words, quoted, remove, written

CHUNK = 1 << 14  # slots ranked together
BUCKET, FAN = 512, 12  # documents of a bucket, on average; bits of buckets summed together
GOLDEN = 0.6180339887498949


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = 17) -> DataFrame:
    """doc_id, source, size and the key that shuffles documents within a source."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))


def targets(sized: DataFrame, share: float = 1.0, most: int = 3, weights: int = 3) -> DataFrame:
    """source, source_size, weight, target: sources by code point, null last, weigh 1, 2, .. weights, repeating; targets share
    `share` of all sizes by weight, stop at `most` times a source's size, and what is over goes to the others by weight until
    none is above. Each round is one sum over the table of sources; only sums come to the driver."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = ranked.withColumn("weight", (F.col("sid") % weights + 1).cast("double")).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    level, fixed = 0.0, None
    while True:
        full = F.col("most") < level * F.col("weight") if fixed is not None else F.lit(False)
        s = t.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if not s["all"] or s["n"] == fixed:
            break
        fixed = s["n"]
        level = max(0.0, share * s["all"] - (s["capped"] or 0.0)) / s["w"] if s["w"] else level
    return t.select("source", "sid", F.col("source_size").cast("long").alias("source_size"), "weight", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, total: float, block: int) -> DataFrame:
    """slot, sid, rank: which source each slot of the mix takes, and how many of its slots came before. sources: sid, target."""
    n = int(-(-total // block))
    shares = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    above = F.sum("target").over(shares) / F.lit(total or 1.0)
    cut = sources.filter("target > 0").withColumn("hi", above).withColumn("lo", F.col("hi") - F.col("target") / F.lit(total or 1.0)).select("sid", "lo", "hi")
    cells = max(1, min(1 << 20, sources.count()))
    last = F.max("sid").over(Window.partitionBy())
    cut = cut.withColumn("hi", F.when(F.col("sid") == last, 1.0).otherwise(F.col("hi")))
    cut = cut.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))))
    i = F.col("slot")
    point = F.pmod(F.shiftright(i, 20).cast("double") * F.lit((GOLDEN * (1 << 20)) % 1.0) + (i % (1 << 20)).cast("double") * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", point).withColumn("cell", F.floor(F.col("u") * cells))
    slots = slots.join(cut, "cell").filter("lo <= u AND u < hi").select("slot", "sid", F.shiftright("slot", 14).alias("chunk"))
    counts = slots.groupBy("sid", "chunk").count()
    base = counts.select("sid", "chunk", (F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(base, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("inside")).alias("rank"))


def taken_blocks(plan: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """sid, block, times, part: how often the mix takes a block whole, and how many of its first words once more."""
    b = F.lit(block)
    s = sources.filter("target > 0").select(
        "sid", "source_size", F.round("target").cast("long").alias("goal"), F.ceil(F.col("source_size") / b).alias("blocks"),
    ).withColumn("slots", F.expr("goal div source_size") * F.col("blocks") + F.ceil((F.col("goal") % F.col("source_size")) / b))
    have = plan.groupBy("sid").agg((F.max("rank") + 1).alias("have"))
    more = s.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < slots").select("sid", F.explode(F.expr("sequence(have, slots - 1)")).alias("rank"))
    all_slots = plan.select("sid", "rank").unionByName(more).join(s, "sid").filter("rank < slots")
    begin = F.expr("rank div blocks") * F.col("source_size") + F.expr("rank % blocks") * b
    length = F.least(b, F.col("source_size") - F.expr("rank % blocks") * b)
    words = F.least(length, F.col("goal") - begin)
    cut = all_slots.select("sid", F.expr("rank % blocks").alias("block"), length.alias("length"), words.alias("words"))
    return cut.groupBy("sid", "block").agg(F.count(F.when(F.col("words") == F.col("length"), 1)).alias("times"), F.coalesce(F.max(F.when(F.col("words") < F.col("length"), F.col("words"))), F.lit(0)).alias("part"))


def running_base(sums: DataFrame) -> DataFrame:
    """sid, bucket, base: what the buckets before hold, in two steps, so that the buckets of a source never meet in one task."""
    s = sums.withColumn("group", F.shiftright("bucket", FAN))
    upto = lambda *by: Window.partitionBy("sid", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    tops = s.groupBy("sid", "group").agg(F.sum("sum").alias("total"))
    tops = tops.select("sid", "group", (F.sum("total").over(upto("group")) - F.col("total")).alias("above"))
    inside = s.withColumn("inside", F.sum("sum").over(upto("group", "bucket")) - F.col("sum"))
    return inside.join(tops, ["sid", "group"]).select("sid", "bucket", (F.col("above") + F.col("inside")).alias("base"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256, share: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken and source per row of df."""
    spark = df.sparkSession
    sized, _ = written(spark, sizes(df, id_col, text_col, source_col), "mix-sizes")
    sources, _ = written(spark, targets(sized, share, most), "mix-sources")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    plan, plan_path = written(spark, schedule(spark, sources, total, block), "mix-schedule")
    blocks, _ = written(spark, taken_blocks(plan, sources, block), "mix-blocks")
    remove(spark, plan_path)
    free(spark)

    n_buckets = max(1, sized.count() // BUCKET)
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    docs = sized.alias("d").join(sources.alias("s"), same).select("doc_id", "d.source", "size", "key", "sid", "source_size", "target", F.pmod(F.shiftright("key", 8), F.lit(n_buckets)).alias("bucket"))
    filled = docs.filter("size > 0")
    sums = filled.groupBy("sid", "bucket").agg(F.sum("size").alias("sum"))
    inside = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    bases, _ = written(spark, running_base(sums), "mix-buckets")
    placed = filled.withColumn("inside", inside).join(bases, ["sid", "bucket"]).withColumn("at", F.col("base") + F.col("inside")).drop("key", "bucket", "base", "inside")
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    lo = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    met = pieces.join(blocks, ["sid", "block"], "left")
    words = F.coalesce("times", F.lit(0)) * (hi - lo) + F.greatest(F.lit(0), F.least(hi, F.coalesce("part", F.lit(0))) - lo)
    taken = met.groupBy("sid", "at", "doc_id", "source", "size", "source_size", "target").agg(F.sum(words).alias("taken"))
    empty = docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source"]
    return taken.select(*cols).unionByName(empty.select(*cols))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256) -> DataFrame:
    """The rows of df, with all their columns, each as often as the mix takes it: taken words over size, to the nearest whole
    number (only the one document at which a source's target ends is ever taken in part). Rows without words are not taken. Rows of
    equal id, source and size share what is taken of them, those first whose text, and then whose row, has the lesser hash."""
    spark = df.sparkSession
    by = mix(df, id_col, text_col, source_col, block).filter("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"), F.round(F.sum("taken") / F.col("size")).cast("long").alias("times"))
    by = by.filter("times > 0").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), "rows", "times")
    by, _ = written(spark, by, "mix-times")
    packed = hashed(df.select(F.struct(*df.columns).alias("row")), "row." + quoted(id_col), "row." + quoted(text_col), "row", F.col("row." + quoted(source_col)).alias("source"))
    packed = packed.select("row", "id", "source", "h1", "h2", n_words(F.col("text")).alias("size"))
    met = packed.join(by, F.col("mix_id").eqNullSafe(F.col("id")) & F.col("mix_source").eqNullSafe(F.col("source")) & (F.col("size") == F.col("mix_size")))
    if by.filter("rows > 1").isEmpty():
        return met.select("row", F.explode(F.expr("sequence(1L, times)")).alias("copy")).select("row.*")
    first = Window.partitionBy("id", "source", "size").orderBy("h1", "h2", F.xxhash64(F.col("row").cast("string")))
    alone = met.filter("rows = 1").select("row", "times")
    shared = met.filter("rows > 1").withColumn("place", F.row_number().over(first)).select("row", (F.expr("times div rows") + (F.col("place") <= F.col("times") % F.col("rows")).cast("long")).alias("times"))
    return alone.unionByName(shared).filter("times > 0").select("row", F.explode(F.expr("sequence(1L, times)")).alias("copy")).select("row.*")
