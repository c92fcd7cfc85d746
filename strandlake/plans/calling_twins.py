"""Calls from genotype likelihoods of parts in six samples (suppliers), taken from the first line of each pair."""

from pyspark.sql import functions as F

from strandlake.operators import consensus_calling, indels
from strandlake.operators.normalise import reference_text
from strandlake.plans import register
from strandlake.plans.record_twins import contig
from strandlake.session import table

#: z by a recursion over samples; frequencies of all, of the first three and of the other samples by fifty rounds each
#: from five starts, of which the best counts.
SPECTRUM = """WITH RECURSIVE f AS (SELECT l_partkey AS site, CAST(l_suppkey % 6 AS INTEGER) AS s, min(l_orderkey * 8 + l_linenumber) AS k FROM lineitem GROUP BY 1, 2),
p AS (SELECT site, s, [CAST(k % 41 AS DOUBLE), CAST((k // 2) % 23 AS DOUBLE), CAST((k // 3) % 47 AS DOUBLE)] AS pl, row_number() OVER (PARTITION BY site ORDER BY s) AS j FROM f),
l AS (SELECT site, s, j, list_transform(pl, lambda x: pow(10, -(x - list_min(pl)) / 10)) AS l FROM p),
z AS (SELECT site, j, list_transform(range(0, 13), lambda i: CASE i WHEN 0 THEN l[1] WHEN 1 THEN 2 * l[2] WHEN 2 THEN l[3] ELSE 0.0 END) AS z FROM l WHERE j = 1
  UNION ALL SELECT l.site, l.j, list_transform(range(1, 14), lambda i: l[1] * z[i] + CASE WHEN i > 1 THEN 2 * l[2] * z[i - 1] ELSE 0 END + CASE WHEN i > 2 THEN l[3] * z[i - 2] ELSE 0 END) FROM z JOIN l ON l.site = z.site AND l.j = z.j + 1),
n AS (SELECT site, arg_max(z, j) AS z, 2 * max(j) AS m FROM z GROUP BY site),
c AS (SELECT site, m, i, z[i + 1] / (factorial(CAST(m AS INTEGER)) / factorial(CAST(i AS INTEGER)) / factorial(CAST(m - i AS INTEGER))) AS v, CASE WHEN i > 0 THEN 0.001 / i END AS prior FROM (SELECT *, unnest(range(0, m + 1)) AS i FROM n)),
d AS (SELECT site, m, i, v, v * coalesce(prior, 1 - sum(coalesce(prior, 0)) OVER (PARTITION BY site)) AS w FROM c),
q AS (SELECT site, CAST(any_value(m) AS INTEGER) AS an, CAST(arg_max(i, v) AS INTEGER) AS ac, sum(w) FILTER (WHERE i = 0) / sum(w) AS p_ref FROM d GROUP BY site),
g AS (SELECT site, 0 AS g, l FROM l UNION ALL SELECT site, CASE WHEN s < 3 THEN 1 ELSE 2 END, l FROM l),
h AS (SELECT site, g, list(l) AS ls FROM g GROUP BY site, g),
e AS (SELECT site, g, ls, 0 AS r, t, t AS f FROM h, (VALUES (0.02::DOUBLE), (0.25), (0.5), (0.75), (0.98)) v(t) UNION ALL
  SELECT site, g, ls, r + 1, t, list_sum(list_transform(ls, lambda x: (2 * f * (1 - f) * x[2] + 2 * f * f * x[3]) / ((1 - f) * (1 - f) * x[1] + 2 * f * (1 - f) * x[2] + f * f * x[3]))) / (2 * len(ls)) FROM e WHERE r < 50),
o AS (SELECT site, g, t, f, list_sum(list_transform(ls, lambda x: ln((1 - f) * (1 - f) * x[1] + 2 * f * (1 - f) * x[2] + f * f * x[3]))) AS lk FROM e WHERE r = 50),
b AS (SELECT site, g, lk, f FROM (SELECT *, row_number() OVER (PARTITION BY site, g ORDER BY t) AS first FROM (SELECT *, max(lk) OVER (PARTITION BY site, g) AS top FROM o) WHERE lk > top - 1e-9) WHERE first = 1),
a AS (SELECT site, max(f) FILTER (WHERE g = 0) AS af, greatest(0, 2 * (coalesce(sum(lk) FILTER (WHERE g > 0), 0) - sum(lk) FILTER (WHERE g = 0))) AS lrt FROM b GROUP BY site)
SELECT site, an, ac, round(least(999, -10 * log10(p_ref)), 6) AS qual, round(af, 6) AS af, round(lrt, 5) AS lrt FROM q JOIN a USING (site)"""


@register("call_spectrum", SPECTRUM)
def call_spectrum(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("site"), (F.col("l_suppkey") % 6).alias("s")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    pl = F.array((F.col("k") % 41).cast("int"), (F.expr("k div 2") % 23).cast("int"), (F.expr("k div 3") % 47).cast("int"))
    df = f.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), pl.alias("PL")))).alias("samples"))
    out = consensus_calling.call_spectrum(df, group=["s0", "s1", "s2"])
    return out.select("site", "call.an", "call.ac", F.round("call.qual", 6).alias("qual"), F.round("call.af", 6).alias("af"), F.round("call.lrt", 5).alias("lrt"))


#: Reads of forty bases are lines; every fifty bases the copies of three samples differ by a deletion of three bases or an insertion of four. The
#: twin tells what was put there, which realignment of the reads has to find again.
PLANTED = """WITH n AS (SELECT count(*) AS n FROM part), m AS (SELECT unnest(range(0, (n - 85) // 50 + 1)) AS m FROM n),
s AS (SELECT m, s, sum(CASE WHEN (m * 7 + s * 3 + c * 5) % 4 = 0 THEN 1 ELSE 0 END) AS copies FROM m, (VALUES (0), (1), (2)) a(s), (VALUES (0), (1)) b(c) GROUP BY m, s)
SELECT m, CAST(CASE WHEN m % 2 = 0 THEN -3 ELSE 4 END AS INTEGER) AS change, 's' || s AS sample, CAST(copies AS INTEGER) AS copies FROM s WHERE m IN (SELECT m FROM s WHERE copies > 0)"""


@register("call_indels", PLANTED)
def call_indels(spark, sf):
    fasta = contig(spark, sf)
    n = table(spark, sf, "part").count()
    li = table(spark, sf, "lineitem")
    pos = F.col("l_partkey") % (n - 50) + 1
    m = F.ceil((pos - 25) / 50)
    at = 50 * m + 25
    x = li.select(F.lit("c").alias("chrom"), pos.alias("pos"), m.alias("m"), (at - pos + 1).alias("k"), (F.col("l_suppkey") % 3).alias("s"), (F.col("l_orderkey") % 2).alias("copy"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), at.alias("at"))
    x = reference_text(x, fasta, F.col("pos"), F.lit(43), "_text")
    carries = (F.col("k") <= 39) & (F.col("at") <= n - 60) & ((F.col("m") * 7 + F.col("s") * 3 + F.col("copy") * 5) % 4 == 0)
    k, gone = F.col("k").cast("int"), carries & (F.col("m") % 2 == 0)
    left, tail, text = F.substring("_text", F.lit(1), k), lambda skip: F.substring("_text", k + 1 + skip, F.lit(43)), lambda *parts: F.substring(F.concat(*parts), 1, 40)
    seq = F.when(gone, text(left, tail(3))).when(carries, text(left, F.lit("GATC"), tail(0))).otherwise(F.substring("_text", 1, 40))
    rest = 36 - k
    cigar = F.when(gone, F.format_string("%dM3D%dM", k, 40 - k)).when(carries & (rest > 0), F.format_string("%dM4I%dM", k, rest)).when(carries, F.format_string("%dM%dS", k, 40 - k)).otherwise("40M")
    reads = x.select("name", F.lit(0).alias("flag"), "chrom", "pos", F.lit(60).alias("mapq"), cigar.alias("cigar"), seq.alias("seq"), F.lit("*").alias("qual"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("rg"))
    called = indels.call_indels(reads, fasta)
    each = called.select(F.floor(F.col("pos") / 50).alias("m"), (F.length(F.get("alt", F.lit(0))) - F.length("ref")).alias("change"), F.explode("samples").alias("s"))
    return each.select("m", "change", "s.sample", F.aggregate("s.gt", F.lit(0), lambda a, g: a + g).alias("copies"))
