"""Sections of the summary report and exact tests, on sites that are made of parts and genotypes that are made of order lines."""

from pyspark.sql import functions as F

from strandlake.functions.expr import compile_filter, compile_value
from strandlake.operators import setops, stats, variants
from strandlake.plans import register
from strandlake.session import table

KIND = "CASE WHEN {a} = ref THEN 'ref' WHEN length({a}) <> length(ref) THEN 'indel' WHEN length(ref) = 1 THEN 'snp' ELSE 'mnp' END"
TS = "ref || '>' || {a} IN ('A>G', 'G>A', 'C>T', 'T>C')"
#: Parts as sites: REF and ALTs are slices of fixed texts by size and key.
SITES = """WITH p AS (SELECT *, substr('ACGTACGT', CAST(p_size % 4 AS INTEGER) + 1, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END) AS ref, substr('CGTACGT', CAST(p_partkey % 4 AS INTEGER) + 1, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END) AS a1, substr('GTAC', CAST(p_size % 3 AS INTEGER) + 1, 1) AS a2 FROM part),
v AS (SELECT p_partkey AS pos, p_size, p_retailprice, ref, CASE WHEN p_partkey % 11 = 0 THEN [] WHEN p_partkey % 3 = 0 THEN [a1, a2] ELSE [a1] END AS alt FROM p),
e AS (SELECT *, i AS k, alt[i] AS a FROM (SELECT *, unnest(range(1, len(alt) + 1)) AS i FROM v)), t AS (SELECT *, """ + KIND.format(a="a") + " AS kind, " + TS.format(a="a") + " AS ts FROM e) "


def sites(spark, sf):
    p = table(spark, sf, "part")
    cut = lambda text, at, n: F.substr(F.lit(text), at.cast("int") + 1, n)
    key, size = F.col("p_partkey"), F.col("p_size")
    a1, a2 = cut("CGTACGT", key % 4, F.when(key % 7 == 0, 2).otherwise(1)), cut("GTAC", size % 3, F.lit(1))
    alt = F.when(key % 11 == 0, F.array().cast("array<string>")).when(key % 3 == 0, F.array(a1, a2)).otherwise(F.array(a1))
    return p.select(F.lit("1").alias("chrom"), key.alias("pos"), "p_size", "p_retailprice", cut("ACGTACGT", size % 4, F.when(key % 5 == 0, 3).otherwise(1)).alias("ref"), alt.alias("alt"))


@register("summary_sites", SITES + """, k AS (SELECT pos, list(DISTINCT kind) AS ks FROM t GROUP BY 1) SELECT CAST(p_size % 3 AS INTEGER) AS files, count(*) AS records, count(*) FILTER (ks IS NULL OR ks = ['ref']) AS no_alts, count(*) FILTER (list_contains(ks, 'snp')) AS snps, count(*) FILTER (list_contains(ks, 'mnp')) AS mnps, count(*) FILTER (list_contains(ks, 'indel')) AS indels, CAST(0 AS BIGINT) AS others, count(*) FILTER (len(alt) > 1) AS multiallelic, count(*) FILTER (len(alt) > 1 AND ks = ['snp']) AS multiallelic_snps FROM v LEFT JOIN k USING (pos) GROUP BY 1""")
def summary_sites(spark, sf):
    return stats.summary(sites(spark, sf).withColumn("files", (F.col("p_size") % 3).cast("int")), "files")


@register("ts_tv_bins", SITES + "SELECT CAST(greatest(0, least(9, floor((p_size - 5) / 4.0))) AS INTEGER) AS bin, count(*) AS snps, count(*) FILTER (ts) AS ts, count(*) FILTER (NOT ts) AS tv FROM t WHERE k = 1 AND kind = 'snp' GROUP BY 1")
def ts_tv_bins(spark, sf):
    return stats.ts_tv_by(sites(spark, sf), F.col("p_size"), 5, 45, 10)


@register("af_spectrum", SITES + ", c AS (SELECT *, CASE WHEN k = 1 THEN pos % 13 ELSE p_size % 5 END AS ac FROM t) SELECT CAST(CASE WHEN ac = 1 THEN -1 ELSE least(9, ac * 10 // 20) END AS INTEGER) AS bin, count(*) FILTER (kind = 'snp') AS snps, count(*) FILTER (kind = 'snp' AND ts) AS ts, count(*) FILTER (kind = 'snp' AND NOT ts) AS tv, count(*) FILTER (kind = 'indel') AS indels FROM c WHERE ac > 0 GROUP BY 1")
def af_spectrum(spark, sf):
    x = sites(spark, sf).withColumn("ac", F.array((F.col("pos") % 13).cast("int"), (F.col("p_size") % 5).cast("int"))).withColumn("an", F.lit(20))
    return stats.af_spectrum(x, "ac", "an", 10)


@register("indel_lengths", SITES + "SELECT CAST(length(a) - length(ref) AS INTEGER) AS length, count(*) AS sites FROM t WHERE kind = 'indel' GROUP BY 1")
def indel_lengths(spark, sf):
    return stats.indel_lengths(sites(spark, sf))


@register("allele_lengths", SITES + ", l AS (SELECT 'ref' AS w, length(ref) AS n FROM v UNION ALL SELECT 'alt', length(a) FROM e) SELECT CAST(n AS INTEGER) AS length, count(*) FILTER (w = 'ref') AS refs, count(*) FILTER (w = 'alt') AS alts, count(*) AS n FROM l GROUP BY 1")
def allele_lengths(spark, sf):
    return stats.allele_lengths(sites(spark, sf))


@register("type_counts", SITES + ", k AS (SELECT pos, list(DISTINCT kind) AS ks FROM t GROUP BY 1) SELECT count(*) AS sites, count(*) FILTER (list_contains(ks, 'snp')) AS snps, count(*) FILTER (list_contains(ks, 'indel')) AS indels, count(*) FILTER (list_contains(ks, 'mnp')) AS mnps, CAST(0 AS BIGINT) AS others, CAST(0 AS INTEGER) AS samples FROM v LEFT JOIN k USING (pos)")
def type_counts(spark, sf):
    return stats.type_counts(sites(spark, sf))


@register("site_tags", SITES + ", k AS (SELECT pos, array_to_string(list_filter(['SNP', 'MNP', 'INDEL'], lambda x: list_contains(list(DISTINCT upper(kind)), x)), ',') AS ks FROM t GROUP BY 1) SELECT v.pos, pos + length(ref) - 1 AS \"END\", CASE WHEN coalesce(ks, '') = '' THEN 'REF' ELSE ks END AS \"TYPE\" FROM v LEFT JOIN k USING (pos)")
def site_tags(spark, sf):
    return stats.site_tags(sites(spark, sf)).select("pos", "END", "TYPE")


@register("filter_type_exact", SITES + ", k AS (SELECT pos, list(DISTINCT kind) FILTER (kind <> 'ref') AS ks FROM t GROUP BY 1) SELECT pos FROM k WHERE ks = ['snp']")
def filter_type_exact(spark, sf):
    df = sites(spark, sf)
    return compile_filter('TYPE="snp"', df).keep(df).select("pos")


@register("filter_type_some", SITES + "SELECT DISTINCT pos FROM t WHERE kind IN ('indel', 'mnp')")
def filter_type_some(spark, sf):
    df = sites(spark, sf)
    return compile_filter('TYPE~"indel" || TYPE~"mnps"', df).keep(df).select("pos")


TAGGED = "WITH f AS (SELECT o_orderkey, list_filter(['LOW', 'DONE', 'NEW'], lambda x: (x = 'LOW' AND o_totalprice < 30000) OR (x = 'DONE' AND o_orderstatus = 'F') OR (x = 'NEW' AND o_orderkey % 3 = 0)) AS f FROM orders) "


def tagged(spark, sf):
    """Orders with soft filters set one after another."""
    o = table(spark, sf, "orders").withColumn("filters", F.array().cast("array<string>"))
    for name, bad in (("LOW", F.col("o_totalprice") < 30000), ("DONE", F.col("o_orderstatus") == "F"), ("NEW", F.col("o_orderkey") % 3 == 0)):
        o = variants.soft_filter(o, ~bad, name)
    return o


@register("filter_of_filter", TAGGED + "SELECT o_orderkey, CASE WHEN f = ['LOW', 'DONE'] THEN 'both' WHEN f = [] THEN 'pass' WHEN list_contains(f, 'NEW') AND list_contains(f, 'DONE') THEN 'some' ELSE 'rest' END AS state FROM f")
def filter_of_filter(spark, sf):
    df = tagged(spark, sf)
    hit = lambda e: compile_filter(e, df).site
    return df.select("o_orderkey", F.when(hit('FILTER="DONE;LOW"'), "both").when(hit('FILTER="PASS"'), "pass").when(hit('FILTER~"NEW;DONE"'), "some").otherwise("rest").alias("state"))


@register("soft_filter_rows", TAGGED + "SELECT o_orderkey, CASE WHEN f = [] THEN 'PASS' ELSE array_to_string(f, ';') END AS filter FROM f")
def soft_filter_rows(spark, sf):
    return tagged(spark, sf).select("o_orderkey", F.array_join("filters", ";").alias("filter"))


#: Genotypes of parts in six samples with alleles 0 to 2; some are missing, some in part.
GENOTYPES = """WITH f AS (SELECT l_partkey AS site, l_suppkey % 6 AS s, min(l_orderkey * 8 + l_linenumber) AS k FROM lineitem GROUP BY 1, 2),
g AS (SELECT site, 's' || s AS sample, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 3 AS INTEGER) END AS a, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN NULL ELSE CAST((k // 3) % 3 AS INTEGER) END AS b, CAST(k % 40 AS INTEGER) AS d0, CAST(k % 23 AS INTEGER) AS d1, CAST(k % 7 AS INTEGER) AS d2 FROM f) """


def genotypes_of(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("site"), (F.col("l_suppkey") % 6).alias("s")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    a = F.when(F.col("k") % 11 != 0, (F.col("k") % 3).cast("int"))
    b = F.when((F.col("k") % 11 != 0) & (F.col("k") % 13 != 0), (F.expr("k div 3") % 3).cast("int"))
    ad = F.array(*((F.col("k") % m).cast("int") for m in (40, 23, 7)))
    return f.select("site", F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), F.array(a, b).alias("gt"), ad.alias("ad"))


def with_samples(spark, sf):
    x = genotypes_of(spark, sf)
    return x.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("sample", "gt", F.col("ad").alias("AD")))).alias("samples"))


EXACT = """k AS (SELECT *, least(nref, nalt) AS rare, unnest(range(least(nref, nalt) % 2, least(nref, nalt) + 1, 2)) AS h FROM {t}), w AS (SELECT *, h * ln(2.0) - lgamma(h + 1) - lgamma((nref - h) // 2 + 1) - lgamma((nalt - h) // 2 + 1) AS lw, nhet * ln(2.0) - lgamma(nhet + 1) - lgamma((nref - nhet) // 2 + 1) - lgamma((nalt - nhet) // 2 + 1) AS own FROM k),
x AS (SELECT {keys}, CASE WHEN min(rare) = 0 THEN 1.0 ELSE sum(exp(lw)) FILTER (lw <= own + 1e-9) / sum(exp(lw)) END AS hwe, CASE WHEN min(rare) = 0 THEN 1.0 ELSE sum(exp(lw)) FILTER (h >= nhet) / sum(exp(lw)) END AS exc FROM w GROUP BY {keys}) """


@register("fill_tags_multi", GENOTYPES + """, c AS (SELECT site, j, sum(CASE WHEN a = j THEN 1 ELSE 0 END + CASE WHEN b = j THEN 1 ELSE 0 END) AS ac, 2 * count(*) FILTER (a = j AND b = j) AS hom, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND a <> b AND (a = j OR b = j)) AS het FROM g, (VALUES (0), (1), (2)) v(j) GROUP BY 1, 2),
s AS (SELECT site, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS ns, count(*) AS n FROM g GROUP BY 1), m AS (SELECT site, sum(ac) AS an, sum(het) AS hets, max(CASE WHEN j = 0 THEN hom END) AS hom0, list_sort(list(ac), 'DESC')[2] AS second FROM c GROUP BY 1),
t AS (SELECT site, j, ac, hom, het AS nhet, an, ns, n, second, CAST(hom0 + hets - het AS BIGINT) AS nref, CAST(het + hom AS BIGINT) AS nalt FROM c JOIN m USING (site) JOIN s USING (site) WHERE j > 0), """ + EXACT.format(t="t", keys="site, j") + """
SELECT site, CAST(j AS INTEGER) AS allele, CAST(ac AS BIGINT) AS AC, CAST(an AS BIGINT) AS AN, CAST(hom AS BIGINT) AS AC_Hom, CAST(nhet AS BIGINT) AS AC_Het, round(hwe, 6) AS HWE, round(exc, 6) AS ExcHet, CASE WHEN an > 0 THEN round(ac / an, 8) END AS AF, CASE WHEN an > 0 THEN round(second / an, 8) END AS MAF, CAST(ns AS BIGINT) AS NS, round(1 - ns / n, 8) AS F_MISSING FROM t JOIN x USING (site, j)""")
def fill_tags_multi(spark, sf):
    t = stats.fill_tags(genotypes_of(spark, sf), ["site"], n_alt=F.lit(2))
    x = t.select("site", "AN", "NS", "F_MISSING", "MAF", F.posexplode(F.arrays_zip("AC", "AF", "AC_Hom", "AC_Het", "HWE", "ExcHet")).alias("k", "e"))
    r = lambda c, n: F.round(c, n)
    return x.select("site", (F.col("k") + 1).alias("allele"), "e.AC", "AN", "e.AC_Hom", "e.AC_Het", r("e.HWE", 6).alias("HWE"), r("e.ExcHet", 6).alias("ExcHet"), r("e.AF", 8).alias("AF"), r("MAF", 8).alias("MAF"), "NS", r("F_MISSING", 8).alias("F_MISSING"))


@register("fill_tags_populations", GENOTYPES + """, q AS (SELECT *, unnest([NULL, CASE WHEN sample IN ('s0', 's1', 's2') THEN 'EAST' ELSE 'WEST' END]) AS population FROM g) SELECT site, population, CAST(count(a) + count(b) AS BIGINT) AS AN, CAST(count(*) FILTER (a = 1) + count(*) FILTER (b = 1) AS BIGINT) AS AC1, CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS NS FROM q GROUP BY 1, 2""")
def fill_tags_populations(spark, sf):
    pops = spark.createDataFrame([(f"s{i}", "EAST" if i < 3 else "WEST") for i in range(6)], "sample string, population string")
    t = stats.fill_tags(genotypes_of(spark, sf), ["site"], n_alt=F.lit(2), populations=pops)
    return t.select("site", "population", "AN", F.get("AC", F.lit(0)).alias("AC1"), "NS")


@register("het_percentiles", GENOTYPES + """, s AS (SELECT site, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS ns, count(a) + count(b) AS an, count(*) FILTER (a = 1) + count(*) FILTER (b = 1) AS ac, count(*) FILTER (a <> b AND (a = 1 OR b = 1)) AS het FROM g GROUP BY 1)
SELECT CAST(least(9, ac * 10 // an) AS INTEGER) AS bin, count(*) AS sites, round(quantile_cont(het / ns, 0.25), 8) AS q25, round(quantile_cont(het / ns, 0.5), 8) AS q50, round(quantile_cont(het / ns, 0.75), 8) AS q75 FROM s WHERE ns > 0 AND ac > 0 GROUP BY 1""")
def het_percentiles(spark, sf):
    t = stats.biallelic(stats.fill_tags(genotypes_of(spark, sf), ["site"], n_alt=F.lit(2)))
    x = stats.het_percentiles(t, 10)
    return x.select("bin", "sites", *(F.round(c, 8).alias(c) for c in ("q25", "q50", "q75")))


@register("vaf_distribution", GENOTYPES + ", x AS (SELECT *, CASE WHEN d0 + d1 + d2 > 0 THEN d1 / (d0 + d1 + d2) + d2 / (d0 + d1 + d2) ELSE 0 END AS v FROM g) SELECT sample, CASE WHEN site % 2 = 0 THEN 'snv' ELSE 'indel' END AS kind, CAST(least(19, floor(v * 20)) AS INTEGER) AS bin, count(*) AS n FROM x GROUP BY ALL")
def vaf_distribution(spark, sf):
    return stats.vaf_distribution(genotypes_of(spark, sf), F.when(F.col("site") % 2 == 0, "snv").otherwise("indel"))


@register("af_deviation", GENOTYPES + ", x AS (SELECT CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) AS n, (site % 10 + 0.5) / 10 AS f FROM g WHERE a IS NOT NULL AND b IS NOT NULL) SELECT CAST(least(9, floor((CASE n WHEN 0 THEN (1 - f) * (1 - f) WHEN 1 THEN 2 * f * (1 - f) ELSE f * f END) * 10)) AS INTEGER) AS bin, count(*) AS n FROM (SELECT n, CAST(f AS DOUBLE) AS f FROM x) GROUP BY 1")
def af_deviation(spark, sf):
    return stats.af_deviation(genotypes_of(spark, sf), (F.col("site") % 10 + 0.5) / 10, 10)


@register("filter_genotype_subscript", GENOTYPES + ", x AS (SELECT *, [d0, d1, d2] AS ad FROM g WHERE a IS NOT NULL AND b IS NOT NULL) SELECT site FROM x GROUP BY site HAVING bool_or(ad[a + 1] > 35 OR ad[b + 1] > 35)")
def filter_genotype_subscript(spark, sf):
    df = with_samples(spark, sf)
    return compile_filter("FMT/AD[GT] > 35", df).keep(df).select("site")


@register("filter_binom_genotype", GENOTYPES + """, x AS (SELECT site, sample, [d0, d1, d2][a + 1] AS m, [d0, d1, d2][b + 1] AS n FROM g WHERE a IS NOT NULL AND b IS NOT NULL), k AS (SELECT *, unnest(range(least(m, n) + 1)) AS k FROM x),
p AS (SELECT site, sample, CASE WHEN m = n THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(m + n + 1) - lgamma(k + 1) - lgamma(m + n - k + 1) - (m + n) * ln(2.0)))) END AS p FROM k GROUP BY site, sample, m, n) SELECT site, round(min(p), 8) AS least FROM p GROUP BY site""")
def filter_binom_genotype(spark, sf):
    df = with_samples(spark, sf)
    return df.select("site", F.round(compile_value("MIN(BINOM(FMT/AD))", df), 8).alias("least")).filter("least IS NOT NULL")


@register("merge_in_order", "WITH a AS (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, l_suppkey % 2 AS src FROM lineitem) SELECT l_partkey, arg_min(l_returnflag, (src, l_orderkey, l_linenumber)) AS flag_first, string_agg(l_returnflag, ',' ORDER BY src, l_orderkey, l_linenumber, l_returnflag) AS flag_append FROM a GROUP BY 1")
def merge_in_order(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"first_flag": F.col("l_returnflag"), "all_flags": F.col("l_returnflag")})
    parts = [li.filter(F.col("l_suppkey") % 2 == k) for k in (0, 1)]
    out = setops.merge_rows(parts, ["l_partkey"], {"first_flag": "first", "all_flags": "append"}, ["l_orderkey", "l_linenumber"])
    return out.select("l_partkey", F.col("first_flag_first").alias("flag_first"), F.col("all_flags_append").alias("flag_append"))


@register("scatter_wide", "SELECT l_orderkey, l_linenumber, l_partkey, CAST((row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) - 1) // 500 AS BIGINT) AS chunk FROM lineitem")
def scatter_wide(spark, sf):
    li = table(spark, sf, "lineitem").repartition(20, "l_suppkey")
    return setops.scatter(li, 500, *map(F.col, ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"))).select("l_orderkey", "l_linenumber", "l_partkey", "chunk")
