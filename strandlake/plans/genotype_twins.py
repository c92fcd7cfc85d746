"""Genotype operators on the six samples of parts (see variant_twins.LONG): phase switches of two trios, setting genotypes, masks of
doses, ploidies, atoms, imputation measures."""

from pyspark.sql import functions as F

from strandlake.functions.project import gt_text
from strandlake.operators import alleles, cohorts, genotypes, variants
from strandlake.plans import register
from strandlake.plans.variant_twins import LONG, long, wide
from strandlake.session import table


@register("switch_rate", LONG + """, h AS (SELECT *, site // 500 AS chrom, NOT missing AND a <> b AS het, NOT missing AND a = 0 AND b = 0 AS rr, NOT missing AND a = 1 AND b = 1 AS aa FROM g),
t AS (SELECT c.sample AS child, c.chrom, c.site, (c.a > 0) = CASE WHEN f.het THEN m.rr ELSE f.aa END AS side FROM h c JOIN h f ON f.site = c.site AND f.sample = CASE c.sample WHEN 's0' THEN 's1' WHEN 's3' THEN 's4' END JOIN h m ON m.site = c.site AND m.sample = CASE c.sample WHEN 's0' THEN 's2' WHEN 's3' THEN 's5' END WHERE c.het AND f.het <> m.het),
s AS (SELECT child, CASE WHEN side <> lag(side) OVER (PARTITION BY child, chrom ORDER BY site) THEN 1 ELSE 0 END AS switched FROM t) SELECT child, count(*) AS n, CAST(sum(switched) AS BIGINT) AS switches FROM s GROUP BY child""")
def switch_rate(spark, sf):
    """Children s0 and s3, each with the next two as father and mother."""
    x = long(spark, sf)
    of = lambda name, kid, who: x.filter(F.col("sample") == who).select("site", F.col("gt").alias(f"{name}_gt"), F.lit(kid).alias("child"))
    trio = lambda c, f, m: of("child", c, c).join(of("father", c, f), ["site", "child"]).join(of("mother", c, m), ["site", "child"])
    both = trio("s0", "s1", "s2").unionByName(trio("s3", "s4", "s5")).withColumn("chrom", F.floor(F.col("site") / 500))
    return cohorts.switch_rate(both, ["chrom", "site"]).select("child", "n", "switches")


TEXT = "CASE WHEN missing THEN './.' ELSE a || '/' || b END"


@register("set_gt_modes", LONG + f"SELECT site, string_agg(CASE WHEN dp < 10 THEN './.' ELSE {TEXT} END, ' ' ORDER BY sample) AS missing, string_agg(CASE WHEN dp < 10 THEN '0/0' ELSE {TEXT} END, ' ' ORDER BY sample) AS ref, string_agg(CASE WHEN dp < 10 AND NOT missing THEN least(a, b) || '/' || greatest(a, b) ELSE {TEXT} END, ' ' ORDER BY sample) AS unphased, string_agg(CASE WHEN dp < 10 THEN replace({TEXT}, '/', '|') ELSE {TEXT} END, ' ' ORDER BY sample) AS phased FROM g GROUP BY site")
def set_gt_modes(spark, sf):
    """Genotypes of low depth set in four ways."""
    df = wide(spark, sf)
    mask = F.transform("samples", lambda s: s["dp"] < 10)
    text = lambda new: F.array_join(F.transform(genotypes.set_gt(F.col("samples"), mask, new), gt_text), " ")
    return df.select("site", text("./.").alias("missing"), text("0").alias("ref"), text("u").alias("unphased"), text("p").alias("phased"))


@register("dosage_masks", LONG + "SELECT site, sample, CAST(CASE WHEN missing THEN 0 ELSE 1 << (a + b) END AS INTEGER) AS mask FROM g")
def dosage_masks(spark, sf):
    return long(spark, sf).select("site", "sample", genotypes.dosage_mask(F.col("gt")).cast("int").alias("mask"))


@register("fix_ploidy", LONG + "SELECT site, string_agg(CASE site % 3 WHEN 0 THEN CASE WHEN missing THEN '.' ELSE a::VARCHAR END WHEN 1 THEN CASE WHEN missing THEN './.' ELSE a || '/' || b END ELSE CASE WHEN missing THEN '././.' ELSE a || '/' || b || '/' || b END END, ' ' ORDER BY sample) AS gts FROM g GROUP BY site")
def fix_ploidy(spark, sf):
    """One, two or three copies by the site."""
    x = variants.fix_ploidy(wide(spark, sf), (F.col("site") % 3 + 1).cast("int"))
    return x.select("site", F.array_join(F.transform("samples", gt_text), " ").alias("gts"))


@register("ploidy_runs", LONG + """, p AS (SELECT sample, site // 500 AS chrom, site AS pos, CASE WHEN site % 40 < 15 THEN 1 ELSE 2 END AS ploidy FROM g WHERE NOT missing),
n AS (SELECT *, CASE WHEN ploidy = lag(ploidy) OVER (PARTITION BY sample, chrom ORDER BY pos) THEN 0 ELSE 1 END AS new FROM p), r AS (SELECT *, sum(new) OVER (PARTITION BY sample, chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT sample, chrom, min(pos) AS beg, max(pos) AS "end", CAST(ploidy AS INTEGER) AS ploidy FROM r GROUP BY sample, chrom, run, ploidy""")
def ploidy_runs(spark, sf):
    x = long(spark, sf).withColumn("chrom", F.floor(F.col("site") / 500)).withColumn("pos", F.col("site"))
    x = x.withColumn("gt", F.when(F.col("site") % 40 < 15, F.slice("gt", 1, 1)).otherwise(F.col("gt")))
    return cohorts.ploidy_runs(x)


ATOMS = """WITH p AS (SELECT p_partkey AS pos, [CAST((p_size + i) % 4 AS INTEGER) for i in [0, 1, 2]] AS r, [CAST((p_size + i + CASE WHEN (p_partkey // (i + 1)) % 2 = 0 THEN 1 ELSE 0 END) % 4 AS INTEGER) for i in [0, 1, 2]] AS a FROM part), e AS (SELECT *, unnest([0, 1, 2]) AS i FROM p)
SELECT pos + i AS pos, pos AS from_pos, substr('ACGT', r[i + 1] + 1, 1) AS ref, substr('ACGT', a[i + 1] + 1, 1) AS alt FROM e WHERE r[i + 1] <> a[i + 1]"""


@register("atomize", ATOMS)
def atomize(spark, sf):
    """Substitutions of three bases, cut into single ones."""
    base = lambda n: F.substr(F.lit("ACGT"), (n % 4).cast("int") + 1, F.lit(1))
    size, key = F.col("p_size"), F.col("p_partkey")
    ref = F.concat(*(base(size + i) for i in range(3)))
    alt = F.concat(*(base(size + i + F.when(F.floor(key / (i + 1)) % 2 == 0, 1).otherwise(0)) for i in range(3)))
    df = table(spark, sf, "part").select(F.lit("c").alias("chrom"), key.alias("pos"), ref.alias("ref"), F.array(alt).alias("alt"))
    return alleles.atomize(df).select("pos", "from_pos", "ref", "alt")


PROBS = """WITH f AS (SELECT l_partkey AS site, l_suppkey % 6 AS s, min(l_orderkey * 8 + l_linenumber) AS k FROM lineitem GROUP BY 1, 2), w AS (SELECT site, s, (1 + k % 7)::DOUBLE AS x, (1 + k % 5)::DOUBLE AS y, (1 + k % 3)::DOUBLE AS z FROM f),
g AS (SELECT site, (y + 2 * z) / (x + y + z) AS e, (y + 4 * z) / (x + y + z) AS f FROM w), t AS (SELECT site, sum(e) / (2 * count(*)) AS theta, sum(f - e * e) AS spread, count(*) AS n FROM g GROUP BY site)
SELECT site, round(CASE WHEN theta <= 0 OR theta >= 1 THEN 1.0 ELSE 1 - spread / (2 * n * theta * (1 - theta)) END, 8) AS info FROM t"""


@register("impute_info", PROBS)
def impute_info(spark, sf):
    k = F.col("k")
    f = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("site"), (F.col("l_suppkey") % 6).alias("s")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    w = F.array((1 + k % 7).cast("double"), (1 + k % 5).cast("double"), (1 + k % 3).cast("double"))
    gp = f.select("site", "s", F.transform(w, lambda x: x / (w[0] + w[1] + w[2])).alias("gp")).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("s", "gp"))).alias("v"))
    return gp.select("site", F.round(variants.impute_info(F.col("v.gp")), 8).alias("info"))
