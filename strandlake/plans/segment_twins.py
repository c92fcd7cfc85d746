"""Copy numbers and shared haplotypes of parts (two hundred in a row are a contig), and the noise of sites made of line items."""

import math

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import copy_number, hmm, peak_fit, sharing, site_noise
from strandlake.plans import register
from strandlake.session import table


def path_sql(t: list[list[float]], init: list[float]) -> str:
    """CTEs from e (chrom, k, pos, p: whole logarithms of the emissions) to x (chrom, pos, state), by the recursion over sites. DuckDB's
    first maximum is the lowest state, as in hmm.decode."""
    n, moves, begin = len(t), hmm.logs(np.array(t)).T.ravel().tolist(), hmm.logs(np.array(init)).tolist()
    return f""", v AS (SELECT chrom, k, list_transform(p, lambda y, i: y + {begin}[i]) AS d, {[[i] for i in range(n)]} AS path FROM e WHERE k = 1
UNION ALL SELECT e.chrom, e.k, list_transform(u.w, lambda s, j: e.p[j] + list_max(s)), list_transform(u.w, lambda s, j: list_append(u.path[list_position(s, list_max(s))], CAST(j - 1 AS INTEGER)))
  FROM (SELECT chrom, k, path, list_transform(range({n}), lambda j: list_transform(d, lambda y, i: y + {moves}[j * {n} + i])) AS w FROM v) u JOIN e ON e.chrom = u.chrom AND e.k = u.k + 1),
z AS (SELECT chrom, arg_max(path[list_position(d, list_max(d))], k) AS path FROM v GROUP BY chrom),
s AS (SELECT chrom, unnest(path) AS state, unnest(range(1, len(path) + 1)) AS k FROM z),
x AS (SELECT e.chrom, e.pos, s.state FROM s JOIN e ON e.chrom = s.chrom AND e.k = s.k)"""


def log_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN CAST(round(ln({p}) * {hmm.UNIT}) AS BIGINT) ELSE {hmm.LOW} END"


CHANGE, DEV, LRR_DEV = 0.02, 0.1, 0.4
PEAK = copy_number.peaks(1.0, DEV)
SITES = "SELECT p_partkey // 200 AS chrom, p_partkey % 200 + 1 AS pos, p_size, CASE WHEN p_size % 17 <> 0 THEN (p_size % 21) / 20.0 END AS baf, (p_size * 13 % 29) / 29.0 - 0.5 AS ratio FROM part"


def _bell(m: float, part: str) -> str:
    return f"exp(-(baf - {m!r}) * (baf - {m!r}) * 0.5 / {PEAK['dev2']!r}) / {PEAK[part]!r} / {math.sqrt(2 * math.pi * PEAK['dev2'])!r}"


def _copies_sql() -> str:
    rr, ra, aa = copy_number.SHARES
    by = {1: f"b0 * ({rr} + {ra} * 0.5) + b1 * ({aa} + {ra} * 0.5)", 2: f"b0 * {rr} + half * {ra} + b1 * {aa}", 3: f"b0 * {rr} + (low + high) * {ra} * 0.5 + b1 * {aa}"}
    of = {k: f"0.0001 + c{k} / (c1 + c2 + c3) * (0.5 + 0.5 * exp(-(lrr - {c}) * (lrr - {c}) / {LRR_DEV**2!r}))" for k, c in zip(by, copy_number.CENTRES)}
    emit = ", ".join(log_sql(f"(CASE WHEN baf IS NULL THEN {0.5 if k == 0 else 0.5 / 3!r} ELSE {of.get(k, '0.0')} END)") for k in range(4))
    return f"""WITH RECURSIVE r AS ({SITES}), m AS (SELECT *, avg(ratio) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS lrr FROM r),
b AS (SELECT *, {_bell(0.0, "in_edge")} AS b0, {_bell(1.0, "in_edge")} AS b1, {_bell(0.5, "in_half")} AS half, {_bell(PEAK["low"], "in_low")} AS low, {_bell(1 - PEAK["low"], "in_low")} AS high FROM m),
c AS (SELECT *, {", ".join(f"{s} AS c{k}" for k, s in by.items())} FROM b),
e AS (SELECT chrom, pos, pos AS k, [{emit}] AS p FROM c)""" + path_sql(copy_number.transition(CHANGE), copy_number.start())


COPIES = _copies_sql()
RUNS = ", y AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - row_number() OVER (PARTITION BY chrom, state ORDER BY pos) AS run FROM x) "


def sites(spark, sf):
    p = table(spark, sf, "part")
    baf = F.when(F.col("p_size") % 17 != 0, (F.col("p_size") % 21) / 20.0)
    return p.select(F.expr("p_partkey div 200").alias("chrom"), (F.col("p_partkey") % 200 + 1).alias("pos"), "p_size", "p_partkey", baf.alias("baf"), (F.col("p_size") * 13 % 29 / 29.0 - 0.5).alias("ratio"))


def copies(spark, sf):
    return copy_number.copy_numbers(sites(spark, sf), ["chrom"], lrr="ratio", change=CHANGE, baf_dev=DEV, lrr_dev=LRR_DEV, lrr_weight=0.5, width=64)


@register("copy_numbers", COPIES + " SELECT chrom, pos, CAST(state AS INTEGER) AS cn FROM x")
def copy_numbers(spark, sf):
    return copies(spark, sf).select("chrom", "pos", "cn")


@register("copy_regions", COPIES + RUNS + 'SELECT y.chrom, min(y.pos) AS beg, max(y.pos) AS "end", CAST(state AS INTEGER) AS cn, count(*) AS sites, count(*) FILTER (baf > 0.25 AND baf < 0.75) AS hets FROM y JOIN r ON r.chrom = y.chrom AND r.pos = y.pos GROUP BY y.chrom, state, run')
def copy_regions(spark, sf):
    return copy_number.copy_regions(copies(spark, sf), ["chrom"], width=64).select("chrom", "beg", "end", "cn", "sites", "hets")


SWITCH, ERROR = 1e-3, 0.01


def _pair_sql() -> str:
    equal = lambda u, v: f"(CASE WHEN {u} = {v} THEN {1 - ERROR!r} ELSE {ERROR!r} END)"
    emit = ["0.25 * 0.25 * 0.25 * 0.25"]
    for first, second in sharing.PAIR[1:]:
        shared = [equal(f"a{h}", c) for h, c in ((first, "c1"), (second, "c2")) if h]
        emit.append(" * ".join(shared if len(shared) == 2 else [*shared, "0.25"]))
    return f"""WITH RECURSIVE h AS (SELECT p_partkey // 200 AS chrom, p_partkey % 200 + 1 AS pos, p_size % 2 AS a1, p_size // 2 % 2 AS a2, CASE WHEN p_partkey // 40 % 2 = 0 THEN p_size // 2 % 2 ELSE p_size // 8 % 2 END AS c1, p_size // 4 % 2 AS c2 FROM part),
e AS (SELECT chrom, pos, pos AS k, [{", ".join(log_sql(f"({p})") for p in emit)}] AS p FROM h)""" + path_sql(sharing.pair_transition(SWITCH), [1 / 7] * 7)


@register("shared_segments", _pair_sql() + RUNS + f'SELECT chrom, min(pos) AS beg, max(pos) AS "end", count(*) AS sites, CAST({[a for a, _ in sharing.PAIR]}[state + 1] AS INTEGER) AS first_from, CAST({[b for _, b in sharing.PAIR]}[state + 1] AS INTEGER) AS second_from FROM y GROUP BY chrom, state, run')
def shared_segments(spark, sf):
    bit = lambda k: F.expr(f"cast(p_size div {k} % 2 as int)")
    x = sites(spark, sf).withColumn("one", F.array(bit(1), bit(2))).withColumn("other", F.array(F.when(F.expr("p_partkey div 40") % 2 == 0, bit(2)).otherwise(bit(8)), bit(4)))
    return sharing.pair_segments(x, ["chrom"], switch=SWITCH, error=ERROR, width=64)


BINS = 10
NOISE = f"""WITH d AS (SELECT l_partkey AS pos, CASE l_suppkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'G' WHEN 2 THEN 'AT' ELSE 'ATT' END AS alt, CASE WHEN l_quantity % 9 + l_linenumber % 4 > 0 THEN CAST(floor({BINS - 1} * (l_linenumber % 4) / (l_quantity % 9 + l_linenumber % 4)) AS INTEGER) END AS bin FROM lineitem),
g AS (SELECT pos, alt, [{", ".join(f"count(*) FILTER (bin = {k})" for k in range(BINS))}] AS dist, count(bin) AS n FROM d GROUP BY pos, alt),
h AS (SELECT *, list_transform(dist, lambda y: y / greatest(list_max(dist), 1)) AS s FROM g),
m AS (SELECT k, sum(s[k + 1] * s[k + 1]) / count(*) - pow(sum(s[k + 1]) / count(*), 2) AS raw FROM h, range({BINS}) t(k) WHERE n > 0 GROUP BY k),
l AS (SELECT least(1.0, min(raw) FILTER (raw > 1e-13)) AS low FROM m),
w AS (SELECT list(CASE WHEN raw > 1e-13 THEN raw ELSE low / (k + 1) END ORDER BY k) AS var FROM m, l),
o AS (SELECT h.*, 10 * ln(1 + {" + ".join(f"s[{k + 1}] * s[{k + 1}] / var[{k + 1}]" for k in range(1, BINS))}) AS own, len(alt) > 1 AS long FROM h, w),
q AS (SELECT *, max(own) OVER (PARTITION BY pos) AS top, min(alt) FILTER (long) OVER (PARTITION BY pos) AS first FROM o)
SELECT q.pos, q.alt, CASE WHEN q.long THEN f.n ELSE q.n END AS n, round(CASE WHEN q.long THEN f.own ELSE q.own + 0.75 * (q.top - q.own) END, 6) AS score FROM q LEFT JOIN o f ON f.pos = q.pos AND f.alt = q.first"""


@register("site_noise", NOISE)
def noise(spark, sf):
    """Five batches, counted for themselves and merged."""
    alt = F.when(F.col("l_suppkey") % 4 == 0, "C").when(F.col("l_suppkey") % 4 == 1, "G").when(F.col("l_suppkey") % 4 == 2, "AT").otherwise("ATT")
    x = table(spark, sf, "lineitem").select(F.lit("c").alias("chrom"), F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"), alt.alias("alt"), (F.col("l_quantity") % 9).alias("n_ref"), (F.col("l_linenumber") % 4).alias("n_alt"), (F.col("l_orderkey") % 5).alias("batch"))
    whole = site_noise.merged([site_noise.profile(x.filter(F.col("batch") == k), bins=BINS) for k in range(5)], BINS)
    return site_noise.scores(whole, bins=BINS).select("pos", "alt", "n", F.round("score", 6).alias("score"))


@register("share_histograms", f"SELECT p_brand, {', '.join(f'count(*) FILTER (least(p_size * 7 % 101 * 20 // 100, 19) = {k}) AS h{k}' for k in range(20))} FROM part WHERE p_size % 17 <> 0 GROUP BY p_brand")
def share_histograms(spark, sf):
    x = table(spark, sf, "part").select("p_brand", F.when(F.col("p_size") % 17 != 0, (F.col("p_size") * 7 % 101) / 100.0).alias("baf"))
    return peak_fit.histograms(x, ["p_brand"], bins=20).select("p_brand", *(F.get("hist", F.lit(k)).alias(f"h{k}") for k in range(20)))


@register("peak_copies")
def peak_copies(spark, sf):
    """Copies of each brand's parts, by shares that scatter about one half or two thirds."""
    x = table(spark, sf, "part").select("p_brand", ((F.col("p_size") % 7 + F.col("p_size") % 11 + F.col("p_size") % 13) / 30.0).alias("baf"))
    return peak_fit.peak_copies(x, ["p_brand"], bins=50).select("p_brand", "copies", F.round("fraction", 4).alias("fraction"), "sites")
