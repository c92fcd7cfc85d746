"""Runs of homozygosity: emissions of a two-state model from genotypes or likelihoods and allele frequencies of many sources, its path by
tiles (see hmm.decode), and the runs.

State 0 is Hardy-Weinberg, state 1 autozygous. With the frequency f of the ALT and the likelihoods of the genotypes RR, RA and AA, a site is
as likely as (1-f)^2 RR + 2 f (1-f) RA + f^2 AA in state 0, and as (1-f) RR + f AA in state 1.

Sites without a frequency, or with one of 0, are left out unless there is a default; so are samples without a genotype, or whose
likelihoods are all equal; only sites with one ALT that was seen count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import hmm
from strandlake.operators.merge import UNOBSERVED

SOURCES = ("tag", "counts", "genotypes", "likelihoods", "table", "default")


def phred(x: Column) -> Column:
    return F.pow(F.lit(10.0), -F.least(x, F.lit(255)) / 10)


def told(pl: Column) -> Column:
    """Whether three likelihoods say anything."""
    return F.coalesce((F.size(pl) >= 3) & ~F.exists(F.slice(pl, 1, 3), lambda x: x.isNull() | (x < 0)) & ~((pl[0] == pl[1]) & (pl[0] == pl[2])), F.lit(False))


def frequency(df: DataFrame, source: str, tag: str = "AF", of: list[str] | None = None, table: DataFrame | None = None, default: float | None = None) -> DataFrame:
    """Adds af, the frequency of the ALT. source: tag (a column with a value for each ALT), counts (columns AC, by ALT, and AN), genotypes or
    likelihoods (gt or PL of the samples, or of those in `of`), table (chrom, pos, ref, alt, af), default (for all alike). default also stands for
    what is missing or 0; without it such sites go."""
    if source not in SOURCES:
        raise ValueError(f"{source} is none of {SOURCES}")
    mine = (lambda s: s["sample"].isin(of)) if of is not None else (lambda s: F.lit(True))
    if source == "tag":
        af = F.get(tag, F.lit(0)).cast("double")
    elif source == "counts":
        af = F.when((F.col("AN") > 0) & (F.get("AC", F.lit(0)) >= 0), F.get("AC", F.lit(0)) / F.col("AN"))
    elif source == "genotypes":
        full = F.filter("samples", lambda s: mine(s) & (F.size(s["gt"]) == 2) & ~F.exists(s["gt"], lambda a: a.isNull()))
        each = F.flatten(F.transform(full, lambda s: s["gt"]))
        af = F.when(F.size(each) > 0, F.size(F.filter(each, lambda a: a > 0)) / F.size(each))
    elif source == "likelihoods":
        some = F.filter("samples", lambda s: mine(s) & told(s["PL"]))
        one = lambda s: (0.5 * phred(s["PL"][1]) + phred(s["PL"][2])) / (phred(s["PL"][0]) + phred(s["PL"][1]) + phred(s["PL"][2]))
        af = F.when(F.size(some) > 0, F.aggregate(F.transform(some, one), F.lit(0.0), lambda a, x: a + x) / F.size(some))
    elif source == "table":
        # of several rows of a site the least frequency, so that the order of tasks does not matter
        known = table.groupBy(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("ref").alias("_r"), F.col("alt").alias("_a")).agg(F.min("af").alias("_af"))
        df = df.join(known, (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.col("ref") == F.col("_r")) & (F.get("alt", F.lit(0)) == F.col("_a")), "left")
        af = F.col("_af")
    else:
        af = F.lit(default).cast("double")
    if default is not None:
        af = F.when(F.coalesce(af, F.lit(0.0)) == 0, F.lit(default)).otherwise(af)
    return df.withColumn("af", af).filter("af > 0").drop("_c", "_p", "_r", "_a", "_af")


def likelihoods(s: Column, error: float | None) -> Column:
    """Of a sample, the three likelihoods of RR, RA and AA that add up to 1, or null. error: taken from the genotype, with this
    probability of an allele being another; else from PL."""
    if error is None:
        p = F.when(told(s["PL"]), F.transform(F.slice(s["PL"], 1, 3), phred))
    else:
        a, b, e = F.get(s["gt"], F.lit(0)), F.get(s["gt"], F.lit(1)), F.lit(float(error))
        same = F.when(a == 0, F.array(1 - e - e * e, e, e * e)).otherwise(F.array(e * e, e, 1 - e - e * e))
        p = F.when((F.size(s["gt"]) == 2) & a.isNotNull() & b.isNotNull(), F.when(a != b, F.array(e, 1 - 2 * e, e)).otherwise(same))
    total = F.aggregate(p, F.lit(0.0), lambda x, y: x + y)
    return F.when(total > 0, F.transform(p, lambda x: x / total))


def emissions(df: DataFrame, error: float | None = None, skip_reference: bool = False) -> DataFrame:
    """sample, chrom, pos, hw, az: by sample and site of df (with af), how likely it is in each state. skip_reference: sites where a sample
    is all but certainly homozygous for REF say nothing of it."""
    single = F.size(F.filter("alt", lambda a: ~a.isin(*UNOBSERVED))) == 1
    x = df.filter(single).select("chrom", "pos", "af", F.explode("samples").alias("s")).select("chrom", "pos", "af", "s.sample", likelihoods(F.col("s"), error).alias("p")).filter("p IS NOT NULL")
    if skip_reference:
        x = x.filter("p[0] <= 0.99")
    f, q = F.col("af"), 1 - F.col("af")
    rr, ra, aa = (F.col("p")[i] for i in range(3))
    return x.select("sample", "chrom", "pos", (q * q * rr + 2 * f * q * ra + f * f * aa).alias("hw"), (q * rr + f * aa).alias("az"))


def autozygous(sites: DataFrame, to_az: float = 6.7e-8, to_hw: float = 5e-9, rate: float | None = None, genetic_map: DataFrame | None = None, width: int = hmm.WIDTH) -> DataFrame:
    """sample, chrom, pos, state, quality (phred, of that state) of emissions. to_az, to_hw: changes of state from a base to the next. rate:
    crossovers by base, by which changes are made rarer; genetic_map: (chrom, pos, cm), the same by the centimorgans between sites, of
    which those between rows of the map are interpolated."""
    x, cross = sites, None
    if rate is not None or genetic_map is not None:
        w = Window.partitionBy("sample", "chrom", "_tile").orderBy("pos")
        x = x.withColumn("_tile", F.floor(F.col("pos") / width))
        first = x.groupBy("sample", "chrom", "_tile").agg(F.max("pos").alias("_end"))
        before = Window.partitionBy("sample", "chrom").orderBy("_tile")  # a row a tile
        x = x.join(first.withColumn("_was", F.lag("_end").over(before)).drop("_end"), ["sample", "chrom", "_tile"])
        x = x.withColumn("_from", F.coalesce(F.lag("pos").over(w), "_was", "pos"))
        if genetic_map is not None:
            m = genetic_map.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("double").alias("x"), F.col("cm").cast("double").alias("y")))).alias("_map"))
            x = x.join(F.broadcast(m) if _small(m) else m, "chrom", "left")
            share = F.abs(centimorgans(F.col("pos")) - centimorgans(F.col("_from"))) / 100
            share = F.coalesce(share, F.lit(0.0)) * (rate or 1.0)
        else:
            share = (F.col("pos") - F.col("_from")) * float(rate)
        x, cross = x.withColumn("_cross", share).select("sample", "chrom", "pos", "hw", "az", "_cross"), "_cross"
    t = [[1 - to_az, to_az], [to_hw, 1 - to_hw]]
    out = hmm.decode(x, ["sample", "chrom"], "pos", ["hw", "az"], t, [0.5, 0.5], cross, width)
    wrong = F.greatest(1 - F.col("prob"), F.lit(1e-10))
    return out.select("sample", "chrom", "pos", "state", (-10 * F.log10(wrong)).alias("quality"))


def _small(m: DataFrame, rows: int = 1_000_000) -> bool:
    """Whether a genetic map has few enough points to go to every task."""
    return (m.agg(F.sum(F.size("_map"))).first()[0] or 0) <= rows


def centimorgans(at: Column) -> Column:
    """By the map of a row: interpolated, flat before its first and after its last point."""
    low = F.filter("_map", lambda p: p["x"] <= at)
    high = F.filter("_map", lambda p: p["x"] > at)
    a, b = F.element_at(low, -1), F.get(high, F.lit(0))
    return F.when(F.size(low) == 0, b["y"]).when(F.size(high) == 0, a["y"]).otherwise(a["y"] + (at - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"]))


def runs(states: DataFrame, width: int = hmm.WIDTH) -> DataFrame:
    """sample, chrom, beg, end, length, sites, quality (mean) of unbroken runs of state 1. Runs are found within tiles of positions and put together over
    their edges, so no window holds a contig."""
    x = states.withColumn("_tile", F.floor(F.col("pos") / width))
    w = Window.partitionBy("sample", "chrom", "_tile").orderBy("pos")
    x = x.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = x.groupBy("sample", "chrom", "_tile", "_run", "state").agg(F.min("pos").alias("beg"), F.max("pos").alias("end"), F.count("*").alias("sites"), F.sum("quality").alias("q"))
    order = Window.partitionBy("sample", "chrom").orderBy("beg")  # a row a run of a tile
    part = part.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(order)).cast("int"), F.lit(1)))
    part = part.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("state = 1")
    out = part.groupBy("sample", "chrom", "_run").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.sum("sites").alias("sites"), F.sum("q").alias("q"))
    return out.select("sample", "chrom", "beg", "end", (F.col("end") - F.col("beg") + 1).alias("length"), "sites", (F.col("q") / F.col("sites")).alias("quality"))
