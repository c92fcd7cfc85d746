"""Variant, cohort and order-dependent operators on the driver's tables: parts are sites, customers' nations or supplier groups
are samples."""

from pyspark.sql import functions as F

from strandlake.functions import stats_math as M
from strandlake.operators import calling, cohorts, consequence, genotypes, sequential, variants
from strandlake.plans import register
from strandlake.session import table

#: Genotypes of sites (parts) in six samples (suppliers modulo six): two alleles from the smallest line of each pair.
LONG = """WITH f AS (SELECT l_partkey, l_suppkey % 6 AS s, min(l_orderkey * 8 + l_linenumber) AS k FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_partkey AS site, 's' || s AS sample, CAST(k % 2 AS INTEGER) AS a, CAST((k // 2) % 3 % 2 AS INTEGER) AS b, k % 11 = 0 AS missing, CAST(k % 40 AS INTEGER) AS dp FROM f) """


def long(spark, sf):
    f = table(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 6).alias("s")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    a, b = (F.col("k") % 2).cast("int"), (F.expr("k div 2") % 3 % 2).cast("int")
    gt = F.when(F.col("k") % 11 == 0, F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).otherwise(F.array(a, b))
    return f.select(F.col("l_partkey").alias("site"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), gt.alias("gt"), (F.col("k") % 40).cast("int").alias("dp"))


def wide(spark, sf):
    """One row per site with an array of samples."""
    x = long(spark, sf).withColumn("phased", F.lit(False))
    return x.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("sample", "gt", "phased", "dp"))).alias("samples")).withColumns({"chrom": F.lit("1"), "pos": F.col("site"), "ref": F.lit("A"), "alt": F.array(F.lit("G")), "id": F.array().cast("array<string>"), "filters": F.array().cast("array<string>"), "qual": (F.col("site") % 60).cast("double")})


@register("view_ac_af", LONG + "SELECT site FROM g GROUP BY site HAVING coalesce(sum(a + b) FILTER (NOT missing), 0) >= 2 AND sum(a + b) FILTER (NOT missing) / (2 * count(*) FILTER (NOT missing)) <= 0.5")
def view_ac_af(spark, sf):
    return variants.view(wide(spark, sf), ac=(2, None, "nref"), af=(None, 0.5, "nref")).select("site")


@register("view_genotype_het", LONG + "SELECT site, CAST(count(*) AS INTEGER) AS n FROM g GROUP BY site HAVING count(*) FILTER (NOT missing AND a <> b) > 0")
def view_genotype_het(spark, sf):
    return variants.view(wide(spark, sf), genotype="het").select("site", F.size("samples").alias("n"))


@register("view_private", LONG + "SELECT site FROM g GROUP BY site HAVING coalesce(sum(a + b) FILTER (NOT missing AND sample IN ('s0', 's1')), 0) > 0 AND coalesce(sum(a + b) FILTER (NOT missing AND sample NOT IN ('s0', 's1')), 0) = 0")
def view_private(spark, sf):
    return variants.private_to(wide(spark, sf), ["s0", "s1"]).select("site")


@register("subset_recount", LONG + "SELECT site, CAST(2 * count(*) FILTER (NOT missing) AS INTEGER) AS an, CAST(coalesce(sum(a + b) FILTER (NOT missing), 0) AS INTEGER) AS ac FROM g WHERE sample IN ('s2', 's4') GROUP BY site")
def subset_recount(spark, sf):
    x = variants.with_counts(variants.subset_samples(wide(spark, sf), ["s2", "s4"]).filter(F.size("samples") > 0))
    return x.select("site", "an", F.get("ac", F.lit(0)).alias("ac"))


@register("genotype_filter_dp", LONG + "SELECT site, string_agg(CASE WHEN missing OR dp < 10 THEN './.' ELSE a || '/' || b END, ',' ORDER BY sample) AS gts FROM g GROUP BY site")
def genotype_filter_dp(spark, sf):
    from strandlake.functions.expr import compile_filter
    from strandlake.functions.project import gt_text

    df = wide(spark, sf)
    x = variants.set_failed_genotypes(df, compile_filter("FMT/dp >= 10", df).mask, None)
    return x.select("site", F.array_join(F.transform("samples", gt_text), ",").alias("gts"))


@register("missing_to_ref", LONG + "SELECT site, CAST(count(*) FILTER (missing OR (a = 0 AND b = 0)) AS BIGINT) AS n_ref FROM g GROUP BY site")
def missing_to_ref(spark, sf):
    x = variants.missing_to_ref(wide(spark, sf))
    return x.select("site", F.size(F.filter("samples", lambda s: M.gt_is(s["gt"], "RR"))).cast("long").alias("n_ref"))


@register("dosage_sum", LONG + "SELECT site, CAST(sum(CASE WHEN missing THEN -1 ELSE a + b END) AS DOUBLE) AS dose FROM g GROUP BY site")
def dosage_sum(spark, sf):
    return long(spark, sf).groupBy("site").agg(F.sum(variants.dosage(F.col("gt"))).alias("dose"))


@register("per_sample_counts", LONG + "SELECT sample, CAST(count(*) FILTER (NOT missing AND a + b = 0) AS BIGINT) AS ref_hom, CAST(count(*) FILTER (NOT missing AND a + b = 2) AS BIGINT) AS alt_hom, CAST(count(*) FILTER (NOT missing AND a + b = 1) AS BIGINT) AS het, CAST(count(*) FILTER (missing) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY sample")
def per_sample_counts(spark, sf):
    return cohorts.per_sample(long(spark, sf)).drop("haploid")


@register("mendelian_counts", LONG + """, t AS (SELECT k.site, k.a AS ka, k.b AS kb, k.missing AS km, f.a AS fa, f.b AS fb, coalesce(f.missing, true) AS fm, m.a AS ma, m.b AS mb, coalesce(m.missing, true) AS mm FROM g k LEFT JOIN g f ON f.site = k.site AND f.sample = 's1' LEFT JOIN g m ON m.site = k.site AND m.sample = 's2' WHERE k.sample = 's0'),
c AS (SELECT CASE WHEN km OR (fm AND mm) THEN 'missing' WHEN fm THEN CASE WHEN ka IN (ma, mb) OR kb IN (ma, mb) THEN 'missing' ELSE 'error' END WHEN mm THEN CASE WHEN ka IN (fa, fb) OR kb IN (fa, fb) THEN 'missing' ELSE 'error' END
WHEN (ka IN (fa, fb) AND kb IN (ma, mb)) OR (kb IN (fa, fb) AND ka IN (ma, mb)) THEN 'good' ELSE 'error' END AS m FROM t) SELECT m, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY m""")
def mendelian_counts(spark, sf):
    trios = spark.createDataFrame([("s0", "s1", "s2")], "child string, father string, mother string")
    t = cohorts.trio_table(long(spark, sf), ["site"], trios)
    return t.groupBy(genotypes.mendelian(F.col("child_gt"), F.col("father_gt"), F.col("mother_gt")).alias("m")).agg(F.count("*").alias("n"))


@register("shared_subsets", LONG + ", m AS (SELECT site, least(a, b) AS x, greatest(a, b) AS y, sum(1 << CAST(substr(sample, 2) AS INTEGER)) AS mask FROM g WHERE NOT missing GROUP BY ALL) SELECT CAST(mask AS BIGINT) AS mask, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def shared_subsets(spark, sf):
    return cohorts.shared_subsets(long(spark, sf), ["site"], [f"s{i}" for i in range(6)]).withColumn("mask", F.col("mask").cast("long"))


@register("contrast_counts", LONG + "SELECT site, CAST(coalesce(sum(2 - a - b) FILTER (sample IN ('s0', 's1', 's2')), 0) AS BIGINT) AS case_ref, CAST(coalesce(sum(a + b) FILTER (sample IN ('s0', 's1', 's2')), 0) AS BIGINT) AS case_alt, CAST(coalesce(sum(2 - a - b) FILTER (sample NOT IN ('s0', 's1', 's2')), 0) AS BIGINT) AS control_ref, CAST(coalesce(sum(a + b) FILTER (sample NOT IN ('s0', 's1', 's2')), 0) AS BIGINT) AS control_alt FROM g WHERE NOT missing GROUP BY site")
def contrast_counts(spark, sf):
    c = cohorts.contrast(long(spark, sf), ["site"], ["s0", "s1", "s2"], ["s3", "s4", "s5"])
    return c.select("site", "case_ref", "case_alt", "control_ref", "control_alt")


@register("contrast_association")
def contrast_association(spark, sf):
    """Exact tests of association of every site (rows only)."""
    c = cohorts.contrast(long(spark, sf), ["site"], ["s0", "s1", "s2"], ["s3", "s4", "s5"])
    return c.select("site", "PASSOC", "FASSOC", "NOVELAL", "NOVELGT")


@register("exclusive_genotypes", LONG + ", x AS (SELECT site, sample IN ('s0', 's1') AS i, least(a, b) * 2 + greatest(a, b) AS v FROM g WHERE NOT missing), o AS (SELECT site, list(DISTINCT v) FILTER (i) AS own, coalesce(list(DISTINCT v) FILTER (NOT i), []) AS other FROM x GROUP BY site) SELECT site FROM o WHERE len(own) = 1 AND NOT list_has_any(own, other)")
def exclusive_genotypes(spark, sf):
    return cohorts.exclusive_genotype(long(spark, sf), ["site"], ["s0", "s1"])


@register("sparse_samples", LONG + ", r AS (SELECT site % 50 AS region, sample, count(*) FILTER (NOT missing) AS n FROM g GROUP BY 1, 2), e AS (SELECT DISTINCT a.region, b.sample FROM (SELECT DISTINCT site % 50 AS region FROM g) a, (SELECT DISTINCT sample FROM g) b) SELECT e.region, e.sample, CAST(coalesce(n, 0) AS BIGINT) AS n FROM e LEFT JOIN r USING (region, sample) WHERE coalesce(n, 0) < 36")
def sparse_samples(spark, sf):
    x = long(spark, sf).withColumn("region", F.col("site") % 50)
    return cohorts.sparse_samples(x, ["region"], x.select("sample"), 36).withColumn("n", F.col("n").cast("long"))


@register("gt_intersection", LONG + ", o AS (SELECT site, sample, CASE WHEN dp % 2 = 0 THEN a ELSE 1 - a END AS a2, b AS b2, missing AS m2 FROM g) SELECT site, sample, CASE WHEN g.missing OR m2 THEN CASE WHEN g.missing AND m2 THEN 'same' ELSE 'masked' END WHEN least(a, b) = least(a2, b2) AND greatest(a, b) = greatest(a2, b2) THEN 'same' ELSE 'masked' END AS state FROM g JOIN o USING (site, sample)")
def gt_intersection(spark, sf):
    x = long(spark, sf)
    y = x.withColumn("gt", F.when(F.col("dp") % 2 == 0, F.col("gt")).otherwise(F.array(1 - F.get("gt", F.lit(0)), F.get("gt", F.lit(1)))))
    out = cohorts.identical_or_missing(x.withColumn("was", F.col("gt")), y, ["site", "sample"])
    both_missing = M.gt_is(F.col("was"), "mis") & M.gt_is(F.col("gt"), "mis")
    other = y.select("site", "sample", F.col("gt").alias("other"))
    out = out.join(other, ["site", "sample"])
    return out.select("site", "sample", F.when(both_missing & M.gt_is(F.col("was"), "mis") & M.gt_is(F.col("other"), "mis"), "same").when(M.gt_is(F.col("gt"), "mis"), "masked").otherwise("same").alias("state"))


@register("severity_rank", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 14 WHEN 2 THEN 18 ELSE 11 END AS rank FROM part")
def severity_rank(spark, sf):
    names = F.array(*map(F.lit, ("intron_variant", "splice_region_variant&missense_variant", "stop_gained", "synonymous_variant")))
    return table(spark, sf, "part").select("p_partkey", consequence.severity(F.get(names, (F.col("p_partkey") % 4).cast("int"))).alias("rank"))


@register("split_packed_worst", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 14 WHEN 2 THEN 18 ELSE 11 END AS r, l_orderkey AS k FROM lineitem) SELECT l_orderkey, CAST(max(r) AS INTEGER) AS severity, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY l_orderkey")
def split_packed_worst(spark, sf):
    """Order lines packed as consequence strings, split again, ranked."""
    names = F.array(*map(F.lit, ("intron_variant", "splice_region_variant&missense_variant", "stop_gained", "synonymous_variant")))
    li = table(spark, sf, "lineitem").withColumn("one", F.concat_ws("|", F.get(names, (F.col("l_partkey") % 4).cast("int")), F.col("l_partkey").cast("string")))
    packed = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("one")), ",").alias("csq"))
    each = consequence.split_packed(packed, F.col("csq"), ["what", "gene"], per_transcript=True)
    return each.groupBy("l_orderkey").agg(F.max(consequence.severity(F.col("what"))).alias("severity"), F.count("*").alias("n"))


TICKS = "WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) // 1000000 AS t FROM events) "


def ticks(spark, sf):
    from strandlake.plans.joins import ticks as of

    return of(spark, sf)


@register("overlap_mark", TICKS + ", i AS (SELECT event_id, user_id, t AS b, t + 3600 * (1 + event_id % 12) AS e FROM e) SELECT event_id FROM i x WHERE EXISTS (SELECT 1 FROM i y WHERE x.user_id = y.user_id AND x.event_id <> y.event_id AND x.b <= y.e AND y.b <= x.e)")
def overlap_mark(spark, sf):
    x = ticks(spark, sf).select("event_id", "user_id", F.col("t").alias("b"), (F.col("t") + 3600 * (1 + F.col("event_id") % 12)).alias("e"))
    return sequential.mark_overlaps(x, ["user_id"], "b", "e").filter("overlap").select("event_id")


@register("overlap_min_weight")
def overlap_min_weight(spark, sf):
    """Overlapping events thinned by least value (rows only)."""
    x = ticks(spark, sf).select("event_id", "user_id", "value", F.col("t").alias("b"), (F.col("t") + 3600 * (1 + F.col("event_id") % 12)).alias("e"))
    return sequential.mark_overlaps(x, ["user_id"], "b", "e", "min", "value").filter("NOT overlap").select("event_id", "user_id")


@register("prune_greedy")
def prune_greedy(spark, sf):
    """At most two events of a user in six hours, the least valued going first (rows only)."""
    return sequential.prune(ticks(spark, sf).select("event_id", "user_id", "t", "value"), ["user_id"], "t", 2, 21600, "value")


@register("depth_blocks", TICKS + ", d AS (SELECT user_id, t // 86400 AS day, count(*) AS n FROM e GROUP BY 1, 2), l AS (SELECT *, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS r FROM d), k AS (SELECT *, CASE WHEN r <> lag(r) OVER w OR day - lag(day) OVER w > 1 OR lag(r) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM l WINDOW w AS (PARTITION BY user_id ORDER BY day)), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS blk FROM k) SELECT user_id, CAST(r AS INTEGER) AS range, min(day) AS beg, max(day) AS \"end\", CAST(min(n) AS BIGINT) AS min_depth FROM b GROUP BY user_id, blk, r")
def depth_blocks(spark, sf):
    d = ticks(spark, sf).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"))
    return sequential.depth_blocks(d, ["user_id"], "day", "n", [1, 3]).select("user_id", "range", "beg", "end", "min_depth")


@register("call_sites")
def call_sites(spark, sf):
    """Multiallelic calls from likelihoods derived from line quantities (rows only)."""
    x = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.array((F.col("l_quantity") * 2).cast("int"), (F.abs(F.col("l_quantity") - 25)).cast("int"), (100 - F.col("l_quantity") * 2).cast("int")))).alias("pl"), F.array(F.lit(0.6), F.lit(0.4)).alias("qs"))
    return calling.call_sites(x.withColumnRenamed("l_partkey", "pos"), keys=("pos",)).select("pos", "qual", F.size("alleles").alias("n_alleles"))


@register("gp_hard_calls", "SELECT l_orderkey, l_linenumber, CASE WHEN greatest(50 - l_quantity, l_quantity - 0.5, 10) = 50 - l_quantity THEN '0/0' WHEN greatest(50 - l_quantity, l_quantity - 0.5, 10) = l_quantity - 0.5 THEN '0/1' ELSE '1/1' END AS gt FROM lineitem")
def gp_hard_calls(spark, sf):
    gp = F.array(50 - F.col("l_quantity"), F.col("l_quantity") - 0.5, F.lit(10.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(variants.gp_to_gt(gp, F.lit(2)), lambda a: a.cast("string")), "/").alias("gt"))


@register("pl_from_gl", "SELECT l_orderkey, l_linenumber, CAST(round(10 * (greatest(l_discount, l_tax) - l_discount)) AS INTEGER) AS p0, CAST(round(10 * (greatest(l_discount, l_tax) - l_tax)) AS INTEGER) AS p1 FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS DOUBLE) AS l_discount, CAST(round(l_tax * 100) AS DOUBLE) AS l_tax FROM lineitem)")
def pl_from_gl(spark, sf):
    pl = variants.gl_to_pl(F.array(F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(pl, F.lit(0)).alias("p0"), F.get(pl, F.lit(1)).alias("p1"))


#: Suppliers of a nation by the difference of their balances: single linkage in one dimension joins neighbours that are near enough.
LINKED = """WITH o AS (SELECT s_suppkey AS sample, s_nationkey AS nation, s_acctbal AS x FROM supplier), g AS (SELECT *, x - lag(x) OVER (PARTITION BY nation ORDER BY x, sample) AS gap FROM o),
c AS (SELECT *, sum(CASE WHEN gap <= 900 THEN 0 ELSE 1 END) OVER (PARTITION BY nation ORDER BY x, sample ROWS UNBOUNDED PRECEDING) AS k FROM g), h AS (SELECT *, CASE WHEN gap <= 900 THEN gap END AS inside FROM c)
SELECT sample, min(sample) OVER (PARTITION BY nation, k) AS cluster, round(coalesce(max(inside) OVER (PARTITION BY nation, k), 0), 2) AS height FROM h WHERE nation IN (SELECT nation FROM o GROUP BY nation HAVING count(*) > 1)"""


@register("cluster_single_linkage", LINKED)
def cluster_single_linkage(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("s_acctbal").alias("xa"))
    t = s.select(F.col("a").alias("b"), "s_nationkey", F.col("xa").alias("xb"))
    pairs = s.join(t, "s_nationkey").filter("a < b").select("a", "b", F.abs(F.col("xa") - F.col("xb")).alias("d"))
    return sequential.cluster_samples(pairs, "a", "b", "d", threshold=900.0).withColumn("height", F.round("height", 2))
