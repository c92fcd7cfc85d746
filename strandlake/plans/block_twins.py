"""Reference blocks of three sources: hours of groups of users, in which a source has events. An hour with three events or more is a variant,
others are blocks by depth."""

from pyspark.sql import functions as F

from strandlake.functions.project import gt_text
from strandlake.operators import blocks, sequential
from strandlake.plans import register
from strandlake.session import table

MERGED = """
WITH d AS (SELECT event_id % 3 AS k, user_id // 20 AS u, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS p, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT *, CASE WHEN n <> lag(n) OVER w OR p - lag(p) OVER w > 1 OR lag(p) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM d WHERE n < 3 WINDOW w AS (PARTITION BY k, u ORDER BY p)),
i AS (SELECT *, sum(new) OVER (PARTITION BY k, u ORDER BY p ROWS UNBOUNDED PRECEDING) AS b FROM l),
r AS (SELECT k, u, min(p) AS beg, max(p) AS fin, min(n) AS dp FROM i GROUP BY k, u, b),
block AS (SELECT * FROM r WHERE fin > beg), var AS (SELECT k, u, p, n FROM d WHERE n >= 3 UNION ALL SELECT k, u, beg, dp FROM r WHERE fin = beg),
cut AS (SELECT u, beg AS p FROM block UNION SELECT u, fin + 1 FROM block UNION SELECT u, p FROM var UNION SELECT u, p + 1 FROM var),
seg AS (SELECT u, p AS beg, lead(p) OVER (PARTITION BY u ORDER BY p) - 1 AS fin FROM cut),
own AS (SELECT s.u, s.beg, s.fin, b.k, '0/0' AS gt, b.dp FROM seg s JOIN block b ON b.u = s.u AND b.beg <= s.beg AND b.fin >= s.fin),
spot AS (SELECT DISTINCT u, p FROM var),
cell AS (
  SELECT u, beg, fin, k, gt, dp FROM own WHERE (u, beg) NOT IN (SELECT (u, p) FROM spot)
  UNION ALL SELECT u, p, NULL, k, CASE WHEN n >= 3 THEN '0/1' ELSE '0/0' END, n FROM var
  UNION ALL SELECT o.u, o.beg, NULL, o.k, o.gt, o.dp FROM own o JOIN spot t ON t.u = o.u AND t.p = o.beg WHERE NOT EXISTS (FROM var v WHERE v.u = o.u AND v.p = o.beg AND v.k = o.k)
)
SELECT u, beg AS pos, fin AS "end", CASE WHEN bool_or(gt = '0/1') THEN 'G' ELSE '' END AS alt, coalesce(max(gt) FILTER (WHERE k = 0), './.') AS g0, coalesce(max(gt) FILTER (WHERE k = 1), './.') AS g1, coalesce(max(gt) FILTER (WHERE k = 2), './.') AS g2, CAST(min(dp) AS BIGINT) AS dp
FROM cell GROUP BY u, beg, fin"""


def source(spark, sf, k):
    e = table(spark, sf, "events").filter(F.col("event_id") % 3 == k)
    d = e.groupBy(F.floor(F.col("user_id") / 20).alias("u"), F.floor(F.unix_timestamp("ts") / 3600).alias("p")).agg(F.count("*").alias("n"))
    block = sequential.depth_blocks(d.filter("n < 3"), ["u"], "p", "n", [1, 2])
    same = lambda x, beg, end, dp, alt, gt: x.select(F.col("u").cast("string").alias("chrom"), F.col(beg).alias("pos"), end.cast("long").alias("end"), F.array().cast("array<string>").alias("id"), F.lit("A").alias("ref"), F.array(*map(F.lit, alt)).cast("array<string>").alias("alt"), F.lit(None).cast("double").alias("qual"), F.array().cast("array<string>").alias("filters"), F.array(F.struct(F.lit(f"s{k}").alias("sample"), F.array(*map(F.lit, gt)).alias("gt"), F.lit(False).alias("phased"), F.col(dp).alias("DP"))).alias("samples"))
    return same(block, "beg", F.col("end"), "min_depth", [], [0, 0]).unionByName(same(d.filter("n >= 3"), "p", F.lit(None), "n", ["G"], [0, 1]))


@register("merge_blocks", MERGED)
def merge_blocks(spark, sf):
    m = blocks.merge_blocks([source(spark, sf, k) for k in range(3)], [[f"s{k}"] for k in range(3)], least="DP", plain=("DP",), tile=64)
    return m.select(F.col("chrom").cast("long").alias("u"), "pos", "end", F.array_join("alt", ",").alias("alt"), *(gt_text(F.get("samples", F.lit(k))).alias(f"g{k}") for k in range(3)), F.col("DP").alias("dp"))
