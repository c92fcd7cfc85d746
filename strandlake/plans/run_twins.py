"""Runs of homozygosity of the six samples of parts: five hundred parts in a row are a contig."""

from pyspark.sql import functions as F

from strandlake.operators import autozygosity
from strandlake.plans import register
from strandlake.plans.variant_twins import LONG, long

#: Paths by the recursion over sites; powers of the two-state matrix in closed form.
RUNS = LONG.replace("WITH f", "WITH RECURSIVE f") + """, d AS (SELECT site // 500 AS chrom, site % 500 + 1 AS pos, sample, a, b, missing FROM g),
af AS (SELECT chrom, pos, sum((a > 0)::INT + (b > 0)::INT) / (2.0 * count(*)) AS f FROM d WHERE NOT missing GROUP BY 1, 2),
l AS (SELECT d.*, f, CASE WHEN a <> b THEN [0.01, 0.98, 0.01] WHEN a = 0 THEN [1 - 0.01 - 0.0001, 0.01, 0.0001] ELSE [0.0001, 0.01, 1 - 0.01 - 0.0001] END AS p FROM d JOIN af USING (chrom, pos) WHERE f > 0 AND NOT missing),
e AS (SELECT chrom, sample, pos, ln((1 - f) * (1 - f) * p[1] + 2 * f * (1 - f) * p[2] + f * f * p[3]) AS hw, ln((1 - f) * p[1] + f * p[3]) AS az,
  row_number() OVER w AS k, coalesce(pos - lag(pos) OVER w, 1) AS gap FROM l WINDOW w AS (PARTITION BY chrom, sample ORDER BY pos)),
t AS (SELECT *, 0.3 / 0.4 * (1 - pow(0.6, gap)) AS up, 0.1 / 0.4 * (1 - pow(0.6, gap)) AS down FROM e),
v AS (SELECT chrom, sample, k, ln(0.5) + hw AS d0, ln(0.5) + az AS d1, [0] AS p0, [1] AS p1 FROM t WHERE k = 1 UNION ALL
  SELECT t.chrom, t.sample, t.k, hw + greatest(d0 + ln(1 - up), d1 + ln(down)), az + greatest(d0 + ln(up), d1 + ln(1 - down)), list_append(CASE WHEN d0 + ln(1 - up) >= d1 + ln(down) THEN p0 ELSE p1 END, 0), list_append(CASE WHEN d0 + ln(up) >= d1 + ln(1 - down) THEN p0 ELSE p1 END, 1)
  FROM v JOIN t ON t.chrom = v.chrom AND t.sample = v.sample AND t.k = v.k + 1),
z AS (SELECT chrom, sample, arg_max(CASE WHEN d0 >= d1 THEN p0 ELSE p1 END, k) AS path FROM v GROUP BY 1, 2),
s AS (SELECT chrom, sample, unnest(path) AS state, unnest(range(1, len(path) + 1)) AS k FROM z),
x AS (SELECT t.chrom, t.sample, t.pos, state FROM s JOIN t ON t.chrom = s.chrom AND t.sample = s.sample AND t.k = s.k) """


def sites(spark, sf):
    d = long(spark, sf).groupBy("site").agg(F.collect_list(F.struct("sample", "gt")).alias("samples"))
    d = d.select(F.floor(F.col("site") / 500).alias("chrom"), (F.col("site") % 500 + 1).alias("pos"), F.lit("A").alias("ref"), F.array(F.lit("G")).alias("alt"), "samples")
    return autozygosity.emissions(autozygosity.frequency(d, "genotypes"), error=0.01)


@register("roh_states", RUNS + "SELECT sample, chrom, pos, CAST(state AS INTEGER) AS state FROM x")
def roh_states(spark, sf):
    return autozygosity.autozygous(sites(spark, sf), 0.3, 0.1, width=128).select("sample", "chrom", "pos", "state")


@register("roh_runs", RUNS + """, n AS (SELECT *, row_number() OVER (PARTITION BY chrom, sample ORDER BY pos) - row_number() OVER (PARTITION BY chrom, sample, state ORDER BY pos) AS run FROM x)
SELECT sample, chrom, min(pos) AS beg, max(pos) AS "end", max(pos) - min(pos) + 1 AS length, count(*) AS sites FROM n WHERE state = 1 GROUP BY sample, chrom, run""")
def roh_runs(spark, sf):
    out = autozygosity.runs(autozygosity.autozygous(sites(spark, sf), 0.3, 0.1, width=128), width=128)
    return out.select("sample", "chrom", "beg", "end", "length", "sites")
