"""Joins: presence masks, intervals, as-of, nearest, annotation, merging."""

from pyspark.sql import functions as F

from strandlake.operators import regions, setops
from strandlake.plans import register
from strandlake.session import table

DAY = 86400


def epoch(c):
    """Seconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def micros(c):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def by_priority(spark, sf, k):
    return [table(spark, sf, "orders").filter(F.col("o_orderpriority").startswith(str(i + 1))).select("o_custkey").distinct() for i in range(k)]


PRESENCE = "WITH p AS (SELECT o_custkey, {} FROM orders GROUP BY o_custkey) "


def bits(k):
    return " || ".join(f"max(CASE WHEN o_orderpriority LIKE '{i + 1}%' THEN '1' ELSE '0' END)" for i in range(k)) + " AS bits, CAST(" + " + ".join(f"max(CASE WHEN o_orderpriority LIKE '{i + 1}%' THEN 1 ELSE 0 END)" for i in range(k)) + " AS INTEGER) AS n"


@register("isec_bitmask_2", PRESENCE.format(bits(2)) + "SELECT o_custkey, bits, n FROM p WHERE n = 2")
def isec_bitmask_2(spark, sf):
    return setops.isec(by_priority(spark, sf, 2), ["o_custkey"], "=2").select("o_custkey", "bits", F.col("n").cast("int").alias("n"))


@register("isec_bitmask_3", PRESENCE.format(bits(3)) + "SELECT o_custkey, bits, n FROM p WHERE n >= 2")
def isec_bitmask_3(spark, sf):
    return setops.isec(by_priority(spark, sf, 3), ["o_custkey"], "+2").select("o_custkey", "bits", F.col("n").cast("int").alias("n"))


@register("isec_exact_bits", PRESENCE.format(bits(3)) + "SELECT o_custkey FROM p WHERE bits = '101'")
def isec_exact_bits(spark, sf):
    return setops.isec(by_priority(spark, sf, 3), ["o_custkey"], "~101").select("o_custkey")


@register("isec_at_most", PRESENCE.format(bits(4)) + "SELECT o_custkey, n FROM p WHERE n BETWEEN 1 AND 2")
def isec_at_most(spark, sf):
    return setops.isec(by_priority(spark, sf, 4), ["o_custkey"], "-2").select("o_custkey", F.col("n").cast("int").alias("n"))


@register("isec_complement", PRESENCE.format(bits(3)) + "SELECT o_custkey FROM p WHERE bits = '100'")
def isec_complement(spark, sf):
    return setops.complement(by_priority(spark, sf, 3), ["o_custkey"])


@register("merge_sum_max_join", """SELECT l_partkey, sum(l_quantity) AS l_quantity_sum, max(l_discount) AS l_discount_max, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS l_suppkey_join, round(sum(l_tax) / count(*), 4) AS l_tax_avg FROM lineitem GROUP BY l_partkey""")
def merge_sum_max_join(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = [li.filter(F.col("l_suppkey") % 2 == k) for k in (0, 1)]
    out = setops.merge_rows(parts, ["l_partkey"], {"l_quantity": "sum", "l_discount": "max", "l_suppkey": "join", "l_tax": "avg"})
    return out.withColumn("l_tax_avg", F.round("l_tax_avg", 4))


@register("merge_outer_columns", """WITH a AS (SELECT l_partkey, sum(l_quantity) AS q_a FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity) AS q_b FROM lineitem WHERE NOT coalesce(l_suppkey % 2 = 0, false) GROUP BY 1) SELECT l_partkey, q_a, q_b FROM a FULL JOIN b USING (l_partkey)""")
def merge_outer_columns(spark, sf):
    """All lines in two sides: suppliers of even number, and the others."""
    li = table(spark, sf, "lineitem")
    even = F.coalesce(F.col("l_suppkey") % 2 == 0, F.lit(False))
    side = lambda rows, name: li.filter(rows).groupBy("l_partkey").agg(F.sum("l_quantity").alias(name))
    return setops.outer_columns(side(even, "q_a"), side(~even, "q_b"), ["l_partkey"])


register("merge_outer_columns_all")(merge_outer_columns)


def windows(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("pri"), F.floor(epoch("o_orderdate") / DAY).alias("beg"), "o_orderkey").withColumn("end", F.col("beg") + F.col("o_orderkey") % 5)


def shipments(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("spri"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("spri", "l_orderkey", "l_linenumber", F.floor(epoch("l_shipdate") / DAY).alias("sbeg")).withColumn("send", F.col("sbeg") + F.col("l_linenumber"))


WINDOWS = """WITH w AS (SELECT o_orderpriority AS pri, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS beg, o_orderkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) + o_orderkey % 5 AS "end" FROM orders),
s AS (SELECT o_orderpriority AS spri, l_orderkey, l_linenumber, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS sbeg, CAST(epoch(l_shipdate) // 86400 AS BIGINT) + l_linenumber AS send FROM lineitem JOIN orders ON l_orderkey = o_orderkey) """


@register("interval_overlap_join", WINDOWS + 'SELECT w.o_orderkey, s.l_orderkey, s.l_linenumber FROM w JOIN s ON pri = spri AND beg <= send AND sbeg <= "end"')
def interval_overlap_join(spark, sf):
    return regions.overlap_join(shipments(spark, sf), windows(spark, sf), [("spri", "pri")], ("sbeg", "send"), ("beg", "end"), parts=regions.parts_of(spark)).select("o_orderkey", "l_orderkey", "l_linenumber")


@register("region_include", WINDOWS + 'SELECT l_orderkey, l_linenumber FROM s WHERE EXISTS (SELECT 1 FROM w WHERE pri = spri AND beg <= send AND sbeg <= "end")')
def region_include(spark, sf):
    return regions.overlap_join(shipments(spark, sf), windows(spark, sf), [("spri", "pri")], ("sbeg", "send"), ("beg", "end"), "left_semi").select("l_orderkey", "l_linenumber")


@register("region_exclude", WINDOWS + 'SELECT l_orderkey, l_linenumber FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE pri = spri AND beg <= send AND sbeg <= "end")')
def region_exclude(spark, sf):
    return regions.overlap_join(shipments(spark, sf), windows(spark, sf), [("spri", "pri")], ("sbeg", "send"), ("beg", "end"), "left_anti").select("l_orderkey", "l_linenumber")


@register("annotate_min_overlap", WINDOWS + 'SELECT w.o_orderkey, s.l_orderkey, s.l_linenumber FROM w JOIN s ON pri = spri AND beg <= send AND sbeg <= "end" WHERE (least(send, "end") - greatest(sbeg, beg) + 1) >= 0.5 * ("end" - beg + 1)')
def annotate_min_overlap(spark, sf):
    shared = F.least("send", "end") - F.greatest("sbeg", "beg") + 1
    return regions.overlap_join(shipments(spark, sf), windows(spark, sf), [("spri", "pri")], ("sbeg", "send"), ("beg", "end"), residual=shared >= 0.5 * (F.col("end") - F.col("beg") + 1), parts=regions.parts_of(spark)).select("o_orderkey", "l_orderkey", "l_linenumber")


@register("annotate_left_range", WINDOWS + 'SELECT s.l_orderkey, s.l_linenumber, CAST(count(w.o_orderkey) AS BIGINT) AS n, min(w.o_orderkey) AS first, CAST(sum(w.o_orderkey) AS BIGINT) AS total FROM s LEFT JOIN w ON pri = spri AND beg <= send AND sbeg <= "end" GROUP BY ALL')
def annotate_left_range(spark, sf):
    out = regions.overlap_totals(shipments(spark, sf), windows(spark, sf), [("spri", "pri")], ("sbeg", "send"), ("beg", "end"), "n", {"total": F.col("o_orderkey")}, {"first": F.col("o_orderkey")})
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("total").alias("total"))


@register("merge_intervals", WINDOWS + """, m AS (SELECT *, max("end") OVER (PARTITION BY pri ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w),
i AS (SELECT *, sum(CASE WHEN pe >= beg THEN 0 ELSE 1 END) OVER (PARTITION BY pri ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT pri, min(beg) AS beg, max("end") AS "end", CAST(count(*) AS BIGINT) AS n FROM i GROUP BY pri, k""")
def merge_intervals(spark, sf):
    return regions.merge_intervals(windows(spark, sf), ["pri"], "beg", "end")


@register("asof_map_interp", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events), q AS (SELECT * FROM e WHERE event_id % 3 = 0), m AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_id % 3 <> 0 GROUP BY 1, 2),
b AS (SELECT q.event_id, q.t, m0.value AS v0, m0.t AS p0 FROM q ASOF LEFT JOIN m m0 ON q.user_id = m0.user_id AND q.t >= m0.t), f AS (SELECT q.event_id, m1.value AS v1, m1.t AS p1 FROM q ASOF LEFT JOIN m m1 ON q.user_id = m1.user_id AND q.t <= m1.t)
SELECT b.event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (t - p0) / (p1 - p0) END, 4) AS value_at FROM b JOIN f USING (event_id)""")
def asof_map_interp(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", micros("ts").alias("t"), "value")
    q = e.filter("event_id % 3 = 0").select("event_id", "user_id", "t")
    m = e.filter("event_id % 3 <> 0").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return regions.interpolate(q, m, ["user_id"], "t", "value").select("event_id", F.round("value_at", 4).alias("value_at"))


@register("asof_backward", "SELECT q.event_id, m.value AS last_purchase FROM events q ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) m ON q.user_id = m.user_id AND q.ts >= m.ts")
def asof_backward(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    m = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return regions.as_of(e.select("event_id", "user_id", "ts"), m, ["user_id"], "ts", "value").select("event_id", F.col("value_backward").alias("last_purchase"))


def ticks(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.floor(micros("ts") / 1_000_000).alias("t"))


TICKS = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS t FROM events) "


@register("nearest_distance", TICKS + ", p AS (SELECT DISTINCT user_id, t FROM e), d AS (SELECT user_id, t, t - lag(t) OVER w AS dist_rev, lead(t) OVER w - t AS dist_fwd FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, dist_rev, dist_fwd, least(dist_rev, dist_fwd) AS dist_nearest FROM e JOIN d USING (user_id, t)")
def nearest_distance(spark, sf):
    return regions.nearest_distance(ticks(spark, sf), ["user_id"], "t").select("event_id", "dist_rev", "dist_fwd", "dist_nearest")


@register("snp_gap", TICKS + "SELECT event_id FROM e a WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(b.t - a.t) <= 86400)")
def snp_gap(spark, sf):
    return regions.near_any(ticks(spark, sf), ["user_id"], "t", F.col("event_type") == "purchase", DAY).filter("event_type <> 'purchase' AND NOT near_mark").select("event_id")


@register("indel_gap", TICKS + ", c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 43200 THEN 0 ELSE 1 END AS nw FROM e), k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS c FROM c) SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, c ORDER BY value DESC, event_id) AS r FROM k) WHERE r = 1")
def indel_gap(spark, sf):
    return regions.best_of_cluster(ticks(spark, sf), ["user_id"], "t", 43200, F.col("value").desc(), F.col("event_id")).select("event_id")


@register("cluster_size", TICKS + ", a AS (SELECT event_id, user_id, t, (SELECT count(*) FROM e b WHERE b.user_id = e.user_id AND b.t BETWEEN e.t AND e.t + 86399) AS n FROM e) SELECT event_id, CAST((SELECT max(n) FROM a b WHERE b.user_id = a.user_id AND b.t BETWEEN a.t - 86399 AND a.t) AS BIGINT) AS cluster_size FROM a")
def cluster_size(spark, sf):
    return regions.cluster_size(ticks(spark, sf), ["user_id"], "t", DAY).select("event_id", "cluster_size")


@register("prune_top_n_per_win", TICKS + "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, t // 604800 ORDER BY value DESC, event_id) AS r FROM e) WHERE r <= 2")
def prune_top_n_per_win(spark, sf):
    e = ticks(spark, sf).withColumn("tile", F.floor(F.col("t") / 604800))
    return setops.top_n(e, ["user_id", "tile"], 2, F.col("value").desc(), F.col("event_id")).select("event_id")


@register("gvcf_islands", TICKS + ", l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT user_id, CAST(run AS BIGINT) AS run, event_type AS label, min(t) AS first, max(t) AS last, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL")
def gvcf_islands(spark, sf):
    return regions.islands(ticks(spark, sf), ["user_id"], ["t", "event_id"], F.col("event_type"), "t").select("user_id", F.col("run").cast("long").alias("run"), "label", "first", "last", "n")


@register("gvcf_expand", "SELECT o_orderkey, CAST(unnest(range(o_orderkey % 5 + 1)) AS BIGINT) + CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS pos FROM orders")
def gvcf_expand(spark, sf):
    return windows(spark, sf).select("o_orderkey", F.explode(F.sequence("beg", "end")).alias("pos"))


# Second names, from when the first ones took a part of the rows.
for _f in (interval_overlap_join, region_include, region_exclude, annotate_min_overlap, annotate_left_range, merge_intervals, gvcf_expand):
    register(f"{_f.__name__}_all")(_f)


@register("annotate_transfer", "SELECT o_orderkey, coalesce(c_mktsegment, '.') AS segment, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS mark FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def annotate_transfer(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", F.coalesce("c_mktsegment", F.lit(".")).alias("segment"), F.col("c_custkey").isNotNull().cast("int").alias("mark"))


@register("annotate_merge_logic", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS p_first, string_agg(o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey) AS p_append, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p_unique, round(sum(o_totalprice), 2) AS t_sum, max(o_totalprice) AS t_max FROM orders GROUP BY o_custkey")
def annotate_merge_logic(spark, sf):
    """Orders of a customer as annotation rows, in the order of their dates."""
    o = table(spark, sf, "orders").withColumns({f"p{k}": F.col("o_orderpriority") for k in (1, 2, 3)}).withColumn("t", F.col("o_totalprice"))
    out = setops.merge_rows([o], ["o_custkey"], {"p1": "first", "p2": "append", "p3": "unique", "t": "sum", "o_totalprice": "max"}, ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", F.col("p1_first").alias("p_first"), F.col("p2_append").alias("p_append"), F.col("p3_unique").alias("p_unique"), F.round("t_sum", 2).alias("t_sum"), F.col("o_totalprice_max").alias("t_max"))


@register("csq_priority_join", "SELECT l_orderkey, arg_min(p_type, (p_size, p_partkey)) AS worst FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def csq_priority_join(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min_by("p_type", F.struct("p_size", "p_partkey")).alias("worst"))


@register("trio_rules", "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS errors FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def trio_rules(spark, sf):
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("errors"))


@register("constrained_targets", "SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON p_partkey = l_partkey")
def constrained_targets(spark, sf):
    n = table(spark, sf, "lineitem").filter("l_quantity > 48").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
