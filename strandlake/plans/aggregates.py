"""Statistics, histograms, comparisons, sorts and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.functions import stats_math as M
from strandlake.operators import alleles, genotypes, hmm, regions, setops, stats
from strandlake.plans import register
from strandlake.session import table


@register("stats_summary", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS open, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders, min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem GROUP BY l_returnflag")
def stats_summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("records"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.countDistinct("l_orderkey").alias("orders"), F.min("l_quantity").alias("mn"), F.max("l_quantity").alias("mx"))


def bases(spark, sf):
    """Parts as substitutions: two bases from the key."""
    p = table(spark, sf, "part")

    return p.select("p_partkey", "p_size", F.element_at(F.split(F.lit("A,C,G,T"), ","), (F.col("p_partkey") % 4 + 1).cast("int")).alias("ref"), F.element_at(F.split(F.lit("A,C,G,T"), ","), (F.expr("p_partkey div 4") % 4 + 1).cast("int")).alias("alt"))


BASES = "WITH b AS (SELECT p_partkey, p_size, substr('ACGT', CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS ref, substr('ACGT', CAST((p_partkey // 4) % 4 + 1 AS BIGINT), 1) AS alt FROM part) "


@register("tstv_like", BASES + "SELECT CAST(count(*) FILTER (ref || '>' || alt IN ('A>G', 'G>A', 'C>T', 'T>C')) AS BIGINT) AS ts, CAST(count(*) FILTER (ref <> alt AND ref || '>' || alt NOT IN ('A>G', 'G>A', 'C>T', 'T>C')) AS BIGINT) AS tv, round(ts / tv, 6) AS ratio FROM b")
def tstv_like(spark, sf):
    return stats.ts_tv(bases(spark, sf), F.col("ref"), F.col("alt")).withColumn("ratio", F.round("ratio", 6))


@register("substitution_types", BASES + "SELECT ref || '>' || alt AS type, CAST(count(*) AS BIGINT) AS n FROM b WHERE ref <> alt GROUP BY 1")
def substitution_types(spark, sf):
    return bases(spark, sf).filter("ref <> alt").groupBy(stats.substitution(F.col("ref"), F.col("alt")).alias("type")).agg(F.count("*").alias("n"))


@register("histogram", "SELECT CAST(CASE WHEN l_quantity < 5 THEN -1 WHEN l_quantity >= 45 THEN 8 ELSE floor((l_quantity - 5) / 5) END AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 8) AS share FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    return stats.histogram(table(spark, sf, "lineitem"), F.col("l_quantity"), 5, 45, 5).withColumn("share", F.round("share", 8))


@register("log_histogram", "SELECT CAST(floor(o_totalprice / pow(10, greatest(0, floor(log10(greatest(o_totalprice, 1))) - 1))) * pow(10, greatest(0, floor(log10(greatest(o_totalprice, 1))) - 1)) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def log_histogram(spark, sf):
    return table(spark, sf, "orders").groupBy(stats.log_bin(F.col("o_totalprice")).alias("bin")).agg(F.count("*").alias("n"))


@register("indel_length_dist", "SELECT CAST(length(p_name) - length(p_type) AS INTEGER) AS ilen, CAST(count(*) AS BIGINT) AS n, round(avg(p_size), 6) AS mean_size FROM part GROUP BY 1")
def indel_length_dist(spark, sf):
    return table(spark, sf, "part").groupBy((F.length("p_name") - F.length("p_type")).alias("ilen")).agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean_size"))


@register("af_bins", "SELECT CAST(least(9, floor(l_discount * 100 + 1e-9)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, CAST(quantile_disc(l_quantity, 0.5) AS DOUBLE) AS med FROM lineitem GROUP BY 1")
def af_bins(spark, sf):
    b = F.least(F.lit(9), F.floor(F.col("l_discount") * 100 + 1e-9)).cast("int")
    return table(spark, sf, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("med"))


@register("concordance_table", "SELECT l_linestatus AS a, o_orderstatus AS b, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def concordance_table(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return genotypes.concordance(a, table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), ["k"], "v")


@register("concordance_nrd", "WITH t AS (SELECT a.s % 3 AS a, b.s % 3 AS b, count(*) AS n FROM (SELECT p_partkey, p_size s FROM part) a JOIN (SELECT l_partkey, CAST(max(l_quantity) AS BIGINT) s FROM lineitem GROUP BY 1) b ON a.p_partkey = b.l_partkey GROUP BY 1, 2) SELECT CAST(sum(n) FILTER (a <> b) AS BIGINT) AS mismatches, CAST(sum(n) FILTER (NOT (a = 0 AND b = 0)) AS BIGINT) AS compared, round(100.0 * sum(n) FILTER (a <> b) / sum(n) FILTER (NOT (a = 0 AND b = 0)), 6) AS nrd FROM t")
def concordance_nrd(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 3).cast("long").alias("v"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg((F.max("l_quantity").cast("long") % 3).alias("v"))
    return genotypes.non_reference_discordance(genotypes.concordance(a, b, ["k"], "v")).withColumn("nrd", F.round("nrd", 6))


def segments(spark, sf):
    """Nations as samples, market segments as sites, a dosage mask from counts."""
    c = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return c.select("c_nationkey", "c_mktsegment", F.expr("shiftleft(1, CAST(n % 3 AS INT))").alias("m"))


SEGMENTS = "WITH s AS (SELECT c_nationkey, c_mktsegment, 1 << CAST(count(*) % 3 AS INTEGER) AS m FROM customer GROUP BY 1, 2), p AS (SELECT a.c_nationkey AS q_sample, b.c_nationkey AS g_sample, CAST(count(*) AS BIGINT) AS n_sites, CAST(count(*) FILTER ((a.m & b.m) <> 0) AS BIGINT) AS n_matches, CAST(count(*) FILTER ((a.m & b.m) = 0) AS BIGINT) AS n_mismatches FROM s a JOIN s b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey > b.c_nationkey GROUP BY 1, 2) "


@register("gtcheck_pairs", SEGMENTS + "SELECT * FROM p")
def gtcheck_pairs(spark, sf):
    s = segments(spark, sf)
    return genotypes.pair_discordance(s, s, ["c_mktsegment"], "c_nationkey", "m", self_join=True)


@register("gtcheck_topn", SEGMENTS + "SELECT q_sample, g_sample, n_mismatches, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_sample ORDER BY n_mismatches, g_sample) AS r FROM p) WHERE r <= 3")
def gtcheck_topn(spark, sf):
    s = segments(spark, sf)
    p = genotypes.pair_discordance(s, s, ["c_mktsegment"], "c_nationkey", "m", self_join=True)
    return setops.top_n(p, ["q_sample"], 3, F.col("n_mismatches"), F.col("g_sample")).select("q_sample", "g_sample", "n_mismatches", "rank")


@register("distinctive_sites", "WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) % 3 AS m FROM customer GROUP BY 1, 2), c AS (SELECT c_mktsegment, m, count(*) AS n FROM s GROUP BY 1, 2) SELECT c_mktsegment, CAST((sum(n) * sum(n) - sum(n * n)) // 2 AS BIGINT) AS pairs FROM c GROUP BY 1")
def distinctive_sites(spark, sf):
    return stats.distinctive_sites(segments(spark, sf), "c_mktsegment", "c_nationkey", "m")


def as_genotypes(spark, sf):
    """Order lines as genotypes of a site (part): two alleles from quantity and discount, missing where tax is nought."""
    li = table(spark, sf, "lineitem")
    a, b = (F.col("l_quantity") >= 40).cast("int"), (F.col("l_quantity") >= 20).cast("int")
    return li.select("l_partkey", "l_returnflag", F.when(F.col("l_tax") > 0, F.array(a, b)).otherwise(F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).alias("gt"))


GENOTYPES = "WITH g AS (SELECT l_partkey, l_returnflag, l_tax > 0 AS called, CAST(l_quantity >= 40 AS INTEGER) + CAST(l_quantity >= 20 AS INTEGER) AS alts FROM lineitem), t AS (SELECT l_partkey, CAST(2 * count(*) FILTER (called) AS BIGINT) AS AN, CAST(coalesce(sum(alts) FILTER (called), 0) AS BIGINT) AS AC, CAST(2 * count(*) FILTER (called AND alts = 2) AS BIGINT) AS AC_Hom, CAST(count(*) FILTER (called AND alts = 1) AS BIGINT) AS AC_Het, CAST(count(*) FILTER (called) AS BIGINT) AS NS, round(1 - count(*) FILTER (called) / count(*), 8) AS F_MISSING FROM g GROUP BY 1) "


@register("fill_tags_counts", GENOTYPES + "SELECT *, CASE WHEN AN > 0 THEN round(AC / AN, 8) END AS AF, CASE WHEN AN > 0 THEN round(least(AC / AN, 1 - AC / AN), 8) END AS MAF FROM t")
def fill_tags_counts(spark, sf):
    x = stats.biallelic(stats.fill_tags(as_genotypes(spark, sf), ["l_partkey"]))
    return x.select("l_partkey", "AN", "AC", "AC_Hom", "AC_Het", "NS", *(F.round(c, 8).alias(c) for c in ("F_MISSING", "AF", "MAF")))


@register("hwe_like", GENOTYPES + ", h AS (SELECT l_partkey, NS AS n, (AC_Hom // 2) AS aa, AC_Het AS ra, NS - AC_Hom // 2 - AC_Het AS rr, (2 * (NS - AC_Hom // 2 - AC_Het) + AC_Het) / (2.0 * NS) AS p FROM t WHERE NS > 0) SELECT l_partkey, round(CASE WHEN n * p * p > 0 THEN (rr - n * p * p) ** 2 / (n * p * p) ELSE 0 END + CASE WHEN 2 * n * p * (1 - p) > 0 THEN (ra - 2 * n * p * (1 - p)) ** 2 / (2 * n * p * (1 - p)) ELSE 0 END + CASE WHEN n * (1 - p) * (1 - p) > 0 THEN (aa - n * (1 - p) * (1 - p)) ** 2 / (n * (1 - p) * (1 - p)) ELSE 0 END, 4) AS chi2 FROM h")
def hwe_like(spark, sf):
    t = stats.biallelic(stats.fill_tags(as_genotypes(spark, sf), ["l_partkey"])).filter("NS > 0")
    aa = F.expr("AC_Hom div 2")
    return t.select("l_partkey", F.round(M.hwe_chi2(F.col("NS") - aa - F.col("AC_Het"), F.col("AC_Het"), aa), 4).alias("chi2"))


LOG_TABLE = "(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1))"


@register("fisher_2x2", f"""WITH t AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, count(*) FILTER (l_returnflag = 'A' AND l_discount < 0.05) AS a, count(*) FILTER (l_returnflag = 'A' AND l_discount >= 0.05) AS b, count(*) FILTER (l_returnflag = 'R' AND l_discount < 0.05) AS c, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.05) AS d FROM lineitem GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM t), l AS (SELECT *, {LOG_TABLE} - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lp, {LOG_TABLE} - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS own FROM k)
SELECT y, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(least(1.0, sum(exp(lp)) FILTER (lp <= own + 1e-7)), 6) AS p FROM l GROUP BY ALL""")
def fisher_2x2(spark, sf):
    """Exact test of return flag against discount by ship year."""
    g = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("y"))
    n = lambda a, b: F.count_if((F.col("l_returnflag") == a) & (F.col("l_discount") < 0.05) if b else (F.col("l_returnflag") == a) & (F.col("l_discount") >= 0.05))
    t = g.agg(n("A", True).alias("a"), n("A", False).alias("b"), n("R", True).alias("c"), n("R", False).alias("d"))
    return stats.fisher_tests(t, "a", "b", "c", "d").withColumn("p", F.round("p", 6))


@register("binom_test", """WITH t AS (SELECT p_brand, count(*) FILTER (p_size <= 25) AS a, count(*) FILTER (p_size > 25) AS b FROM part GROUP BY 1), k AS (SELECT *, unnest(range(least(a, b) + 1)) AS k FROM t)
SELECT p_brand, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(CASE WHEN a = b THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - (a + b) * ln(2.0)))) END, 8) AS p FROM k GROUP BY p_brand, a, b""")
def binom_test(spark, sf):
    """Two-sided binomial test of two counts by part brand."""
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") <= 25).alias("a"), F.count_if(F.col("p_size") > 25).alias("b"))
    return g.select("p_brand", "a", "b", F.round(M.binom_two_sided(F.col("a"), F.col("b")), 8).alias("p"))


@register("ld_pairs", "WITH q AS (SELECT l_partkey, l_suppkey % 20 AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT a.l_partkey AS x, b.l_partkey AS y, CAST(count(*) AS BIGINT) AS n, round(pow(corr(a.q, b.q), 2), 6) AS r2 FROM q a JOIN q b ON a.s = b.s AND b.l_partkey BETWEEN a.l_partkey + 1 AND a.l_partkey + 3 GROUP BY 1, 2 HAVING count(*) >= 5")
def ld_pairs(spark, sf):
    """r2 of the quantity vectors of neighbouring parts (window of three)."""
    q = table(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 20).alias("s")).agg(F.sum("l_quantity").alias("q"))
    a = q.select(F.explode(F.sequence(F.col("l_partkey") + 1, F.col("l_partkey") + 3)).alias("y"), F.col("l_partkey").alias("x"), "s", F.col("q").alias("qa"))
    met = a.join(q.select(F.col("l_partkey").alias("y"), "s", F.col("q").alias("qb")), ["y", "s"])
    return genotypes.ld(met, ["x", "y"], "qa", "qb").filter("n >= 5").withColumn("r2", F.round("r2", 6))


register("ld_pairs_all")(ld_pairs)


@register("norm_split", "SELECT p_partkey, CAST(i AS INTEGER) AS alt_index, string_split(p_type, ' ')[i] AS alt FROM (SELECT p_partkey, p_type, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part)")
def norm_split(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("alt"))
    return alleles.split_rows(p).select("p_partkey", F.col("alt_index").cast("int").alias("alt_index"), F.get("alt", F.lit(0)).alias("alt"))


@register("norm_join", "SELECT p_brand, p_size, array_to_string(list(p_name ORDER BY p_name, p_partkey), '|') AS alts, array_to_string(list(p_partkey ORDER BY p_name, p_partkey), '|') AS keys FROM part GROUP BY ALL")
def norm_join(spark, sf):
    j = alleles.join_rows(table(spark, sf, "part"), ["p_brand", "p_size"], "p_name", ("p_partkey",))
    return j.select("p_brand", "p_size", F.array_join("p_name", "|").alias("alts"), F.array_join(F.transform("p_partkey", lambda x: x.cast("string")), "|").alias("keys"))


@register("dedup_exact", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedup_exact(spark, sf):
    o = table(spark, sf, "orders")
    return setops.first_of(o, [F.col(c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority")], F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderkey")


@register("sort_multi_key", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def sort_multi_key(spark, sf):
    """All orders with their places, newest first: range partitions and their offsets, so no task sees all rows."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    places = setops.scatter(o, 1, F.col("o_orderdate").desc(), F.col("o_orderkey").asc())
    return places.select("o_orderkey", (F.col("chunk") + 1).cast("long").alias("place")).orderBy("place")


register("sort_multi_key_all")(sort_multi_key)


@register("concat_union", "SELECT o_orderkey, CAST(0 AS INTEGER) AS src FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER) FROM orders WHERE o_orderkey % 3 <> 1")
def concat_union(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return setops.concat([o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1")])


@register("concat_dedup", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE 1 END AS INTEGER) AS src FROM orders")
def concat_dedup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return setops.concat([o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1")], ["o_orderkey"])


@register("scatter_n", "SELECT chunk, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS chunk FROM orders) GROUP BY 1")
def scatter_n(spark, sf):
    return setops.scatter(table(spark, sf, "orders").select("o_orderkey"), 1000, F.col("o_orderkey")).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@register("set_except_intersect", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_except_intersect(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").exceptAll(table(spark, sf, "orders").filter("o_totalprice > 200000").select("o_custkey").distinct())


@register("per_contig_counts", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def per_contig_counts(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@register("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM events")
def moving_average(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 4).alias("smooth"))


@register("phase_switches", "WITH e AS (SELECT user_id, event_type, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events) SELECT user_id, CAST(sum(s) AS BIGINT) AS switches, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1")
def phase_switches(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("s", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(0)))
    return e.groupBy("user_id").agg(F.sum("s").alias("switches"), F.count("*").alias("n"))


@register("subset_lattice", "SELECT m, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, CAST(bit_or(1 << (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1)) AS BIGINT) AS m FROM orders GROUP BY 1) GROUP BY 1")
def subset_lattice(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.bit_or(F.expr("shiftleft(1L, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1)")).alias("m"))
    return o.groupBy("m").agg(F.count("*").alias("n"))


@register("runs_viterbi", """WITH RECURSIVE e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS "at", least(0.95, greatest(0.05, value / 100)) AS hi FROM events),
v AS (SELECT user_id, "at", ln(0.5) + ln(1 - hi) AS d0, ln(0.5) + ln(hi) AS d1, [0] AS p0, [1] AS p1 FROM e WHERE "at" = 1 UNION ALL
SELECT e.user_id, e."at", ln(1 - hi) + greatest(d0 + ln(0.9), d1 + ln(0.2)), ln(hi) + greatest(d0 + ln(0.1), d1 + ln(0.8)), CASE WHEN d0 + ln(0.9) >= d1 + ln(0.2) THEN list_append(p0, 0) ELSE list_append(p1, 0) END, CASE WHEN d0 + ln(0.1) >= d1 + ln(0.8) THEN list_append(p0, 1) ELSE list_append(p1, 1) END FROM v JOIN e ON e.user_id = v.user_id AND e."at" = v."at" + 1),
b AS (SELECT user_id, arg_max(CASE WHEN d0 >= d1 THEN p0 ELSE p1 END, "at") AS path FROM v GROUP BY user_id) SELECT user_id, CAST(unnest(range(1, len(path) + 1)) AS INTEGER) AS "at", CAST(unnest(path) AS INTEGER) AS state FROM b""")
def runs_viterbi(spark, sf):
    """Two hidden states (quiet, busy) of each user decoded from event values."""
    return decoded_users(spark, sf).select("user_id", "at", "state")


def decoded_users(spark, sf):
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("at", F.row_number().over(w)).withColumn("hi", F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("value") / 100)))
    return hmm.decode(e.withColumn("lo", 1 - F.col("hi")), ["user_id"], "at", ["lo", "hi"], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5])


@register("runs_posterior")
def runs_posterior(spark, sf):
    """Probability of the decoded state of each event (tested against all paths in tests/test_variants.py)."""
    return decoded_users(spark, sf).select("user_id", "at", F.round("prob", 6).alias("prob"))


@register("edit_distance", "SELECT a.p_partkey AS x, b.p_partkey AS y, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def edit_distance(spark, sf):
    return setops.edit_distances(table(spark, sf, "part"), ["p_brand", "p_size"], "p_partkey", "p_name", regions.parts_of(spark))


@register("html_strip", "SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS INTEGER) AS n FROM pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("n"))


@register("role_turns", "SELECT role, CAST(count(*) AS BIGINT) AS turns, CAST(count(DISTINCT conv_id) AS BIGINT) AS convs, CAST(max(turn) AS BIGINT) AS last FROM conversations GROUP BY role")
def role_turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("convs"), F.max("turn").alias("last"))
