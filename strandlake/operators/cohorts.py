"""Statistics of groups of samples on long genotypes (site columns, sample, gt) and small sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import stats_math as M


def _missing(g: Column) -> Column:
    return g.isNull() | F.exists(g, lambda a: a.isNull())


def contrast(long: DataFrame, site: list[str], cases: list[str], controls: list[str]) -> DataFrame:
    """Reference and ALT allele counts of cases and controls, their exact test (PASSOC), ALT shares (FASSOC), and samples with
    an allele that no control has (NOVELAL), or else a genotype that none has (NOVELGT)."""
    x = long.filter(F.col("sample").isin(*cases, *controls)).withColumn("case", F.col("sample").isin(cases)).filter(~_missing(F.col("gt")))
    alts, n = F.size(F.filter("gt", lambda a: a > 0)), F.size("gt")
    g = x.groupBy(*site).agg(
        F.sum(F.when(F.col("case"), n - alts).otherwise(0)).alias("case_ref"), F.sum(F.when(F.col("case"), alts).otherwise(0)).alias("case_alt"),
        F.sum(F.when(~F.col("case"), n - alts).otherwise(0)).alias("control_ref"), F.sum(F.when(~F.col("case"), alts).otherwise(0)).alias("control_alt"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("case"), F.col("gt"))))).alias("_alleles"), F.collect_set(F.when(~F.col("case"), F.array_sort("gt"))).alias("_gts"),
        F.array_sort(F.collect_set(F.when(F.col("case"), F.struct("sample", "gt")))).alias("_cases"),
    )
    new = F.transform(F.filter("_cases", lambda s: F.size(F.array_except(s["gt"], F.col("_alleles"))) > 0), lambda s: s["sample"])
    gts = F.transform(F.filter("_cases", lambda s: ~F.array_contains("_gts", F.array_sort(s["gt"]))), lambda s: s["sample"])
    out = g.withColumn("NOVELAL", new).withColumn("NOVELGT", F.when(F.size("NOVELAL") == 0, gts).otherwise(F.array().cast("array<string>")))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return out.withColumn("PASSOC", M.fisher_exact(F.col("case_ref"), F.col("case_alt"), F.col("control_ref"), F.col("control_alt"))).withColumn("FASSOC", F.array(share("control_alt", "control_ref"), share("case_alt", "case_ref"))).drop("_alleles", "_gts", "_cases")


def ad_bias(long: DataFrame, site: list[str], pairs: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """Exact tests of allele depths (ad: REF, ALT) of pairs (a, b) of samples, those below the threshold."""
    s = long.select(*site, "sample", F.get("ad", F.lit(0)).alias("r"), F.get("ad", F.lit(1)).alias("v"))
    a = s.withColumnsRenamed({"sample": "a", "r": "ra", "v": "va"})
    b = s.withColumnsRenamed({"sample": "b", "r": "rb", "v": "vb"})
    x = pairs.join(a, "a").join(b, [*site, "b"]).filter("va + vb > 0")
    return x.withColumn("p", M.fisher_exact(F.col("ra"), F.col("va"), F.col("rb"), F.col("vb"))).filter(F.col("p") < threshold)


def shared_subsets(long: DataFrame, site: list[str], samples: list[str]) -> DataFrame:
    """mask, n: how often just this subset of samples (bit i: samples[i]; 63 at most) shares a genotype at a site."""
    if len(samples) > 63:
        raise ValueError("a mask has room for 63 samples")
    bit = F.create_map(*(F.lit(x) for i, s in enumerate(samples) for x in (s, 1 << i)))
    x = long.filter(~_missing(F.col("gt")) & F.col("sample").isin(samples)).withColumn("g", F.array_sort("gt"))
    m = x.groupBy(*site, "g").agg(F.bit_or(bit[F.col("sample")]).alias("mask"))
    return m.groupBy("mask").agg(F.count("*").alias("n"))


def exclusive_genotype(long: DataFrame, site: list[str], chosen: list[str]) -> DataFrame:
    """Sites at which the chosen samples share a genotype that no other sample has; missing genotypes pass."""
    x = long.withColumn("g", F.when(~_missing(F.col("gt")), F.array_sort("gt"))).withColumn("in", F.col("sample").isin(chosen))
    g = x.groupBy(*site).agg(F.collect_set(F.when(F.col("in"), F.col("g"))).alias("own"), F.collect_set(F.when(~F.col("in"), F.col("g"))).alias("other"))
    return g.filter((F.size("own") == 1) & ~F.arrays_overlap("own", "other")).select(*site)


def ploidy_runs(long: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """sample, chrom, beg, end, ploidy: runs of equal ploidy; rows without a genotype are skipped."""
    from strandlake.operators.regions import islands

    x = long.filter(F.col("gt").isNotNull() & ~F.forall("gt", lambda a: a.isNull()))
    return islands(x, ["sample", chrom], [pos], F.size("gt"), pos).select("sample", chrom, F.col("first").alias("beg"), F.col("last").alias("end"), F.col("label").alias("ploidy"))


def sparse_samples(long: DataFrame, region: list[str], samples: DataFrame, least: int) -> DataFrame:
    """Region and sample with fewer than `least` called genotypes; samples without any row count as none."""
    n = long.filter(~_missing(F.col("gt"))).groupBy(*region, "sample").agg(F.count("*").alias("n"))
    every = long.select(*region).distinct().crossJoin(F.broadcast(samples.select("sample").distinct()))  # regions x samples is the report itself
    return every.join(n, [*region, "sample"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)


def guess_ploidy(long: DataFrame, pl: str = "pl", error: float = 1e-3) -> DataFrame:
    """sample, n, lk_haploid, lk_diploid, sex: mean log-likelihoods of one or two copies from phred likelihoods (RR, RA, AA) and
    the sites' ALT frequency (af)."""
    p = lambda i: F.pow(F.lit(10.0), -F.get(pl, F.lit(i)) / 10)
    f = F.col("af")
    hap = p(0) * (1 - f) + p(2) * f
    dip = p(0) * (1 - f) * (1 - f) + 2 * p(1) * f * (1 - f) + p(2) * f * f
    ok = long.filter((F.size(pl) == 3) & f.isNotNull())
    g = ok.groupBy("sample").agg(F.count("*").alias("n"), F.avg(F.log10(F.greatest(hap, F.lit(error)))).alias("lk_haploid"), F.avg(F.log10(F.greatest(dip, F.lit(error)))).alias("lk_diploid"))
    return g.withColumn("sex", F.when(F.col("lk_haploid") > F.col("lk_diploid"), "M").otherwise("F"))


def trio_table(long: DataFrame, site: list[str], trios: DataFrame) -> DataFrame:
    """One row per site and trio (child, father, mother) with the three genotypes."""
    side = lambda role: long.select(*site, F.col("sample").alias(role), F.col("gt").alias(f"{role}_gt"))
    x = trios.select("child", "father", "mother")
    return x.join(side("child"), "child").join(side("father"), [*site, "father"], "left").join(side("mother"), [*site, "mother"], "left")


def trio_stats(trios: DataFrame) -> DataFrame:
    """Of each child: Mendelian counts, transmitted and untransmitted ALT alleles of heterozygous parents with a reference partner."""
    from strandlake.operators.genotypes import mendelian

    m = mendelian(F.col("child_gt"), F.col("father_gt"), F.col("mother_gt"))
    het = lambda g: M.gt_is(g, "het")
    ref = lambda g: M.gt_is(g, "RR")
    can = (het(F.col("father_gt")) & ref(F.col("mother_gt"))) | (het(F.col("mother_gt")) & ref(F.col("father_gt")))
    has = M.gt_is(F.col("child_gt"), "het")
    return trios.withColumn("m", m).groupBy("child").agg(*(F.count_if(F.col("m") == k).alias(k) for k in ("good", "error", "missing")), F.count_if(can & has).alias("transmitted"), F.count_if(can & ref(F.col("child_gt"))).alias("untransmitted"))


def switch_rate(trios: DataFrame, order: list[str]) -> DataFrame:
    """Phase switches of each child at sites where it is heterozygous and just one parent is: whether the ALT allele stands on the
    same side as before."""
    het = M.gt_is(F.col("child_gt"), "het")
    one = M.gt_is(F.col("father_gt"), "het") != M.gt_is(F.col("mother_gt"), "het")
    from_father = F.when(M.gt_is(F.col("father_gt"), "het"), M.gt_is(F.col("mother_gt"), "RR")).otherwise(M.gt_is(F.col("father_gt"), "AA"))
    side = (F.get("child_gt", F.lit(0)) > 0) == from_father
    x = trios.filter(het & one).withColumn("side", side)
    w = Window.partitionBy("child", *order[:-1]).orderBy(order[-1])
    x = x.withColumn("switched", F.coalesce((F.col("side") != F.lag("side").over(w)).cast("int"), F.lit(0)))
    return x.groupBy("child").agg(F.count("*").alias("n"), F.sum("switched").alias("switches")).withColumn("rate", F.col("switches") / F.col("n"))


def per_sample(long: DataFrame) -> DataFrame:
    """Counts of genotype classes of each sample."""
    n = lambda k: F.count_if(M.gt_is(F.col("gt"), k))
    return long.groupBy("sample").agg(n("RR").alias("ref_hom"), n("AA").alias("alt_hom"), n("het").alias("het"), n("hap").alias("haploid"), n("mis").alias("missing"), F.count("*").alias("n"))


def identical_or_missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a with genotypes that differ from those of b set to missing; rows without a partner stay."""
    x = a.join(b.select(*keys, F.col("gt").alias("_b")), keys, "left")
    same = F.col("_b").isNull() | (F.array_sort("gt") == F.array_sort("_b"))
    return x.withColumn("gt", F.when(same, F.col("gt")).otherwise(F.transform("gt", lambda _: F.lit(None).cast("int")))).drop("_b")


def ligation_swaps(overlap: DataFrame) -> DataFrame:
    """sample, chunk, swap, quality for overlaps of phased chunks (sample, chunk, a, b: genotypes of a het site in two
    neighbours): a majority of crossed phases swaps, and swaps add up along the chunks."""
    x = overlap.filter(M.gt_is(F.col("a"), "het") & M.gt_is(F.col("b"), "het"))
    g = x.groupBy("sample", "chunk").agg(F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") == F.reverse("b")).alias("crossed"))
    w = Window.partitionBy("sample").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    f = F.least("same", "crossed") / (F.col("same") + F.col("crossed"))
    pq = F.when(f == 0, 99.0).otherwise(99 * (0.7 + f * F.log(f) + (1 - f) * F.log(1 - f)) / 0.7)
    return g.withColumn("swap", F.sum((F.col("crossed") > F.col("same")).cast("int")).over(w) % 2 == 1).withColumn("quality", F.greatest(F.lit(0.0), pq))
