"""Filter expressions, projections and record editing."""

from pyspark.sql import functions as F

from strandlake.functions.expr import compile_filter, compile_value, expand_grid
from strandlake.functions.project import Projector
from strandlake.plans import register
from strandlake.session import table


def lines_of_orders(spark, sf, limit_cols=("l_quantity",)):
    """Orders with their lines as an array of samples."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("sample"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")).alias("s"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("samples"))


@register("filter_expr_basic", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount > 0.05 AND l_returnflag = 'R'")
def filter_expr_basic(spark, sf):
    df = table(spark, sf, "lineitem")
    return compile_filter('l_quantity >= 10 && l_discount > 0.05 && l_returnflag = "R"', df).keep(df).select("l_orderkey", "l_linenumber", "l_quantity")


@register("filter_expr_and_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_tax > 0.07) AND (l_linestatus = 'O' OR l_extendedprice > 50000)")
def filter_expr_and_or(spark, sf):
    df = table(spark, sf, "lineitem")
    return compile_filter('(l_quantity<5 || l_tax>0.07) && (l_linestatus="O" || l_extendedprice>50000)', df).keep(df).select("l_orderkey", "l_linenumber")


@register("filter_expr_regex", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[A-M].*[A-Z]$') AND NOT regexp_matches(p_brand, '1')")
def filter_expr_regex(spark, sf):
    df = table(spark, sf, "part")
    return compile_filter('p_type ~ "^[A-M].*[A-Z]$" && p_brand !~ "1"', df).keep(df).select("p_partkey", "p_type")


@register("filter_expr_inlist", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
def filter_expr_inlist(spark, sf):
    df = table(spark, sf, "orders")
    return compile_filter("o_orderpriority=@urgent && o_orderstatus!=@done", df, sets={"urgent": ["1-URGENT", "2-HIGH"], "done": ["F"]}).keep(df).select("o_orderkey", "o_orderpriority")


@register("filter_exclude", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000 OR o_orderstatus = 'O')")
def filter_exclude(spark, sf):
    df = table(spark, sf, "orders")
    return compile_filter('o_totalprice>100000 || o_orderstatus="O"', df).drop(df).select("o_orderkey")


@register("filter_arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity AS unit, CAST(l_orderkey AS BIGINT) % 7 AS rest FROM lineitem WHERE l_extendedprice * (1 - l_discount) / l_quantity > 1500")
def filter_arithmetic(spark, sf):
    """The remainder is a value."""
    df = table(spark, sf, "lineitem")
    hit = compile_filter("l_extendedprice*(1-l_discount)/l_quantity > 1500", df).site
    unit = compile_value("l_extendedprice*(1-l_discount)/l_quantity", df)
    return df.filter(hit).select("l_orderkey", "l_linenumber", unit.alias("unit"), compile_value("l_orderkey % 7", df).cast("long").alias("rest"))


register("filter_arithmetic_all")(filter_arithmetic)


@register(
    "filter_missing_logic",
    """SELECT c_custkey, CAST(count(*) FILTER (o_totalprice IS NULL) AS BIGINT) AS eq_missing, CAST(count(*) FILTER (o_totalprice IS DISTINCT FROM 1000.0) AS BIGINT) AS ne_const,
    CAST(count(*) FILTER (coalesce(o_totalprice < 50000, false)) AS BIGINT) AS lt FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def filter_missing_logic(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    n = lambda e: F.count_if(compile_filter(e, df).site)
    return df.groupBy("c_custkey").agg(n('o_totalprice="."').alias("eq_missing"), n("o_totalprice != 1000").alias("ne_const"), n("o_totalprice < 50000").alias("lt"))


@register("filter_vector_any", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity > 49) AND bool_or(l_quantity <> 50)")
def filter_vector_any(spark, sf):
    df = lines_of_orders(spark, sf)
    return compile_filter("FMT/q > 49 && FMT/q != 50", df).keep(df).select("l_orderkey", F.size("samples").cast("long").alias("n"))


@register("filter_same_sample", "SELECT l_orderkey, CAST(count(*) FILTER (l_quantity > 40 AND l_discount < 0.03) AS BIGINT) AS hits FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity > 40 AND l_discount < 0.03)")
def filter_same_sample(spark, sf):
    df = lines_of_orders(spark, sf)
    c = compile_filter("FMT/q > 40 & FMT/d < 0.03", df)
    return df.filter(c.site).select("l_orderkey", F.size(F.filter(c.mask, lambda x: x)).cast("long").alias("hits"))


@register("filter_or_sample_masks", "SELECT l_orderkey, CAST(count(*) FILTER (l_quantity > 45 OR l_discount > 0.09) AS BIGINT) AS hits FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity > 45 OR l_discount > 0.09)")
def filter_or_sample_masks(spark, sf):
    df = lines_of_orders(spark, sf)
    c = compile_filter("FMT/q > 45 | FMT/d > 0.09", df)
    return df.filter(c.site).select("l_orderkey", F.size(F.filter(c.mask, lambda x: x)).cast("long").alias("hits"))


@register(
    "filter_smpl_agg",
    """SELECT l_orderkey, max(l_quantity) AS mx, min(l_quantity) AS mn, round(avg(l_quantity), 6) AS av, CAST(median(l_quantity) AS DOUBLE) AS med, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_pop(l_quantity) END, 6) AS sd, sum(l_quantity) AS sm
    FROM lineitem GROUP BY l_orderkey HAVING avg(l_quantity) > 30""",
)
def filter_smpl_agg(spark, sf):
    df = lines_of_orders(spark, sf)
    v = lambda e: compile_value(e, df)
    return compile_filter("AVG(FMT/q) > 30", df).keep(df).select("l_orderkey", v("MAX(FMT/q)").alias("mx"), v("MIN(FMT/q)").alias("mn"), F.round(v("AVG(FMT/q)"), 6).alias("av"), v("MEDIAN(FMT/q)").alias("med"), F.round(v("STDEV(FMT/q)"), 6).alias("sd"), v("SUM(FMT/q)").alias("sm"))


@register("filter_n_pass", "SELECT l_orderkey, CAST(count(*) FILTER (l_quantity >= 25) AS DOUBLE) AS n_pass, round(count(*) FILTER (l_quantity >= 25) / count(*), 6) AS f_pass FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_quantity >= 25) >= 3")
def filter_n_pass(spark, sf):
    df = lines_of_orders(spark, sf)
    return compile_filter("N_PASS(FMT/q>=25) >= 3", df).keep(df).select("l_orderkey", compile_value("N_PASS(FMT/q>=25)", df).alias("n_pass"), F.round(compile_value("F_PASS(FMT/q>=25)", df), 6).alias("f_pass"))


@register("filter_subscript", "WITH s AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_discount) q FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM s WHERE coalesce(q[1] > 30, false) AND coalesce(q[2] < 10 OR q[3] < 10, false)")
def filter_subscript(spark, sf):
    df = lines_of_orders(spark, sf).select("l_orderkey", F.transform("samples", lambda s: s["q"]).alias("q"))
    return compile_filter("q[0] > 30 && q[1-2] < 10", df).keep(df).select("l_orderkey")


@register("strlen_abs_phred", "SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS len, CAST(round(abs(p_size - 25.0), 6) AS DOUBLE) AS dev, round(-10 * log10(p_size / 100.0), 6) AS ph FROM part WHERE length(p_name) > 8")
def strlen_abs_phred(spark, sf):
    df = table(spark, sf, "part")
    one = lambda e: F.get(compile_value(e, df), F.lit(0))
    return compile_filter("STRLEN(p_name) > 8", df).keep(df).select("p_partkey", one("STRLEN(p_name)").alias("len"), F.round(one("ABS(p_size-25)"), 6).alias("dev"), F.round(one("PHRED(p_size/100)"), 6).alias("ph"))


@register("view_count_range", "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) BETWEEN 3 AND 5")
def view_count_range(spark, sf):
    df = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return compile_filter("n>=3 && n<=5", df).keep(df).join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("soft_filter", "SELECT o_orderkey, CASE WHEN o_totalprice < 30000 AND o_orderstatus = 'F' THEN 'LOW;DONE' WHEN o_totalprice < 30000 THEN 'LOW' WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'PASS' END AS filter FROM orders")
def soft_filter(spark, sf):
    df = table(spark, sf, "orders")
    tags = F.array_compact(F.array(F.when(compile_filter("o_totalprice < 30000", df).site, F.lit("LOW")), F.when(compile_filter('o_orderstatus="F"', df).site, F.lit("DONE"))))
    return df.select("o_orderkey", F.when(F.size(tags) == 0, "PASS").otherwise(F.array_join(tags, ";")).alias("filter"))


@register("set_gt_mask", "SELECT l_orderkey, string_agg(CASE WHEN l_quantity < 10 THEN './.' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END, ',' ORDER BY l_linenumber, l_quantity, l_discount) AS gts FROM lineitem GROUP BY l_orderkey")
def set_gt_mask(spark, sf):
    df = lines_of_orders(spark, sf)
    mask = compile_filter("FMT/q < 10", df).mask
    return df.select("l_orderkey", F.array_join(F.zip_with("samples", mask, lambda s, m: F.when(m, "./.").otherwise(s["q"].cast("long").cast("string"))), ",").alias("gts"))


@register("query_format", "SELECT o_orderkey || chr(9) || o_orderstatus || ':' || o_orderpriority AS line FROM orders WHERE o_orderstatus = 'P'")
def query_format(spark, sf):
    df = table(spark, sf, "orders")
    return compile_filter('o_orderstatus="P"', df).keep(df).select(Projector(df).compile(r"%o_orderkey\t%o_orderstatus:%o_orderpriority").alias("line"))


@register("query_loop", "SELECT l_orderkey || string_agg(' ' || l_linenumber || '=' || CAST(l_quantity AS BIGINT), '' ORDER BY l_linenumber, l_quantity, l_discount) AS line FROM lineitem GROUP BY l_orderkey")
def query_loop(spark, sf):
    df = lines_of_orders(spark, sf)
    return df.select(Projector(df).compile("%l_orderkey[ %SAMPLE=%q]").alias("line"))


@register("sample_stats_grid", "SELECT t AS threshold, l_returnflag, CAST(count(*) FILTER (l_quantity >= t AND l_discount >= 0.05) AS BIGINT) AS n FROM lineitem, (VALUES (10), (20), (40)) v(t) GROUP BY ALL")
def sample_stats_grid(spark, sf):
    df = table(spark, sf, "lineitem")
    grid = expand_grid("l_quantity >= {10,20,40} && l_discount >= 0.05")
    found = df.groupBy("l_returnflag").agg(*(F.count_if(compile_filter(e, df).site).alias(str(t)) for t, e in zip((10, 20, 40), grid)))
    return found.unpivot("l_returnflag", ["10", "20", "40"], "threshold", "n").withColumn("threshold", F.col("threshold").cast("int"))


@register("remove_columns", "SELECT o_orderkey, o_custkey, upper(o_orderstatus) AS status FROM orders")
def remove_columns(spark, sf):
    return table(spark, sf, "orders").drop("o_totalprice", "o_orderdate", "o_orderpriority").withColumnRenamed("o_orderstatus", "status").withColumn("status", F.upper("status"))


@register("json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def json_props(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.from_json("props", "k BIGINT")["k"]).groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))
