"""Annotation, normalising and reference checks on records that are made of parts; the reference is one contig whose bases are given
by the parts' sizes."""

from pyspark.sql import functions as F

from strandlake.operators import annotate, merge, normalise, variants
from strandlake.plans import register
from strandlake.session import table
from strandlake.sources.text_formats import tiled

#: Records: REF and ALT of a part by its key; the contig c has the base of (p_size % 4) at each key.
RECORDS = """WITH p AS (SELECT p_partkey + 1 AS pos, p_size, p_brand, p_type, p_retailprice, substr('ACGT', CAST(p_size % 4 AS INTEGER) + 1, 1) AS base, substr('ACGT', CAST((p_size + CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 4 ELSE 0 END) % 4 AS INTEGER) + 1, 1) AS ref, substr('ACGT', CAST((p_size + 1 + p_partkey % 3) % 4 AS INTEGER) + 1, 1) AS a1 FROM part) """


def letter(i):
    return F.substr(F.lit("ACGT"), (i % 4).cast("int") + 1, F.lit(1))


def contig(spark, sf):
    """Tiles; parts are numbered without gaps from 0, and the bases from 1."""
    return tiled(table(spark, sf, "part").select(F.lit("c").alias("chrom"), (F.col("p_partkey") + 1).alias("pos"), letter(F.col("p_size")).alias("text")), normalise.WIDTH)


def records(spark, sf):
    p = table(spark, sf, "part")
    shift = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") % 4).otherwise(0)
    return p.select(F.lit("c").alias("chrom"), (F.col("p_partkey") + 1).alias("pos"), F.array().cast("array<string>").alias("id"), letter(F.col("p_size") + shift).alias("ref"), F.array(letter(F.col("p_size") + 1 + F.col("p_partkey") % 3)).alias("alt"), "p_size", "p_brand", "p_type", "p_retailprice")


@register("check_ref_warn", RECORDS + "SELECT pos, ref = base AS ok FROM p")
def check_ref_warn(spark, sf):
    return normalise.check_ref(records(spark, sf), contig(spark, sf)).select("pos", F.col("ref_ok").alias("ok"))


@register("check_ref_set", RECORDS + "SELECT pos, base AS ref, CASE WHEN ref <> base AND a1 = base THEN ref ELSE a1 END AS alt FROM p")
def check_ref_set(spark, sf):
    return normalise.check_ref(records(spark, sf), contig(spark, sf), "s").select("pos", "ref", F.get("alt", F.lit(0)).alias("alt"))


FIX = RECORDS + """, f AS (SELECT *, translate(ref, 'ACGT', 'TGCA') AS cr, translate(a1, 'ACGT', 'TGCA') AS ca, CASE WHEN ref = a1 THEN 'none' WHEN least(ref, a1) || greatest(ref, a1) IN ('AT', 'CG') THEN CASE WHEN ref = base THEN 'ok' ELSE 'skip' END WHEN ref = base THEN 'ok' WHEN a1 = base THEN 'swap' WHEN translate(ref, 'ACGT', 'TGCA') = base THEN 'flip' WHEN translate(a1, 'ACGT', 'TGCA') = base THEN 'flip+swap' ELSE 'unresolved' END AS what FROM p) """


@register("fix_ref_flip", FIX + "SELECT pos, what, CASE what WHEN 'swap' THEN a1 WHEN 'flip' THEN cr WHEN 'flip+swap' THEN ca ELSE ref END AS ref, CASE what WHEN 'swap' THEN ref WHEN 'flip' THEN ca WHEN 'flip+swap' THEN cr ELSE a1 END AS alt FROM f")
def fix_ref_flip(spark, sf):
    return normalise.fix_ref(records(spark, sf), contig(spark, sf)).select("pos", F.col("fixref").alias("what"), "ref", F.get("alt", F.lit(0)).alias("alt"))


@register("fill_from_fasta", RECORDS + "SELECT pos, base AS aa FROM p")
def fill_from_fasta(spark, sf):
    return normalise.fill_from_fasta(records(spark, sf), contig(spark, sf), "aa").select("pos", "aa")


@register("old_record", RECORDS + "SELECT pos, 'c|' || pos || '|' || ref || '|' || a1 AS old_rec FROM p")
def old_record(spark, sf):
    return normalise.old_record(records(spark, sf)).select("pos", "old_rec")


@register("merge_equal_alts", RECORDS + "SELECT pos, a1 || CASE WHEN a1 <> ref THEN ',' || ref ELSE '' END AS alts FROM p")
def merge_equal_alts(spark, sf):
    x = records(spark, sf).withColumn("alt", F.array(F.get("alt", F.lit(0)), F.lower(F.get("alt", F.lit(0))), F.col("ref")))
    return normalise.merge_equal_alts(x).select("pos", F.array_join("alt", ",").alias("alts"))


@register("split_genotype_values", "SELECT l_orderkey, l_linenumber, k AS allele, CAST(l_quantity AS BIGINT) AS g00, CAST(l_quantity AS BIGINT) + CASE k WHEN 1 THEN 1 ELSE 3 END AS g01, CAST(l_quantity AS BIGINT) + CASE k WHEN 1 THEN 2 ELSE 5 END AS g11 FROM lineitem, (VALUES (1), (2)) v(k)")
def split_genotype_values(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    x = li.withColumn("g", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("q") + i)).withColumn("allele", F.explode(F.array(F.lit(1), F.lit(2))))
    out = x.withColumn("s", normalise.split_genotype_values(F.col("g"), F.col("allele")))
    return out.select("l_orderkey", "l_linenumber", "allele", *(F.get("s", F.lit(i)).alias(n) for i, n in enumerate(("g00", "g01", "g11"))))


# Annotation rows: a supplier's line of a part says an allele of it.
ANN = RECORDS + """, a AS (SELECT l_partkey + 1 AS pos, substr('ACGT', CAST(l_suppkey % 4 AS INTEGER) + 1, 1) AS x, l_orderkey, l_linenumber, l_quantity FROM lineitem) """


def said(spark, sf):
    li = table(spark, sf, "lineitem")
    r = records(spark, sf).select("pos", "ref")
    return li.join(r, F.col("l_partkey") + 1 == F.col("pos")).select(F.lit("c").alias("chrom"), "pos", "ref", F.concat(letter(F.col("l_suppkey")), F.lit(",N")).alias("alt"), "l_orderkey", "l_linenumber", "l_quantity")


@register("annotate_by_alleles", ANN + "SELECT p.pos, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS qty FROM p LEFT JOIN a ON p.pos = a.pos AND a.x = p.a1 GROUP BY p.pos")
def annotate_by_alleles(spark, sf):
    out = annotate.by_alleles(records(spark, sf), said(spark, sf), {"l_quantity": "qty"}, order=["l_orderkey", "l_linenumber"])
    return out.select("pos", "qty")


@register("annotate_extra_match", ANN + "SELECT p.pos, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS qty FROM p LEFT JOIN a ON p.pos = a.pos AND a.x = p.a1 AND l_quantity > p_size GROUP BY p.pos")
def annotate_extra_match(spark, sf):
    out = annotate.by_alleles(records(spark, sf), said(spark, sf), {"l_quantity": "qty"}, order=["l_orderkey", "l_linenumber"], extra="ann_l_quantity > p_size")
    return out.select("pos", "qty")


@register("annotate_by_record", RECORDS + ", b AS (SELECT pos, CASE WHEN pos % 2 = 0 THEN a1 ELSE substr('ACGT', CAST((p_size + 2) % 4 AS INTEGER) + 1, 1) END AS b1, p_brand FROM p) SELECT p.pos, CASE WHEN a1 = b1 THEN b.p_brand END AS exact, b.p_brand AS some_snp FROM p JOIN b USING (pos)")
def annotate_by_record(spark, sf):
    """Records against others at the same places, of which half have the same ALT: by equal alleles and by any record."""
    r = records(spark, sf)
    b = r.withColumn("alt", F.when(F.col("pos") % 2 == 0, F.col("alt")).otherwise(F.array(letter(F.col("p_size") + 2)))).withColumn("name", F.col("p_brand"))
    x = annotate.by_record(r, b, {"name": "exact"}, "exact")
    return annotate.by_record(x, b, {"name": "some_snp"}, "all").select("pos", "exact", "some_snp")


@register("transfer_modes", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_orderpriority ELSE c_mktsegment END AS replaced, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, c_mktsegment) AS filled, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(c_mktsegment, o_orderpriority) END AS existing, c_mktsegment AS carried FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def transfer_modes(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    half = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    o = table(spark, sf, "orders").withColumns({"replaced": F.col("o_orderpriority"), "filled": half, "existing": half, "carried": F.col("o_orderpriority")})
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    for name, mode in (("replaced", ""), ("filled", "+"), ("existing", "-"), ("carried", ".")):
        x = variants.transfer(x, name, F.col("c_mktsegment"), mode)
    return x.select("o_orderkey", "replaced", "filled", "existing", "carried")


@register("set_id", RECORDS + "SELECT pos, CASE WHEN pos % 3 = 0 THEN 'rs' || pos ELSE 'c:' || pos || ':' || ref || ':' || a1 END AS id FROM p")
def set_id(spark, sf):
    r = records(spark, sf).withColumn("id", F.when(F.col("pos") % 3 == 0, F.array(F.concat(F.lit("rs"), F.col("pos").cast("string")))).otherwise(F.col("id")))
    return annotate.set_id(r, "+%CHROM:%POS:%REF:%ALT{0}").select("pos", F.array_join("id", ";").alias("id"))


@register("rename_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def rename_values(spark, sf):
    names = spark.createDataFrame([("F", "done"), ("O", "open"), ("X", "never")], "old string, new string")
    return annotate.rename_values(table(spark, sf, "orders"), "o_orderstatus", names).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@register("known_frequency", RECORDS + "SELECT pos, CASE WHEN pos % 2 = 0 AND pos % 5 <> 0 THEN p_size / 100.0 ELSE 0.4 END AS af FROM p")
def known_frequency(spark, sf):
    r = records(spark, sf)
    af = r.filter("pos % 2 = 0").select("chrom", "pos", "ref", F.when(F.col("pos") % 5 == 0, "N").otherwise(F.array_join("alt", ",")).alias("alt"), (F.col("p_size") / 100.0).alias("af"))
    return annotate.known_frequency(r, af, 0.4).select("pos", "af")


@register("constrained_calls", RECORDS + "SELECT pos, pos % 4 = 0 AS missed, CASE WHEN pos % 4 <> 0 THEN CASE WHEN base = ref THEN 0 WHEN base = a1 THEN 1 ELSE -1 END END AS first FROM p WHERE pos % 3 = 0")
def constrained_calls(spark, sf):
    """Every third part is a target; every fourth has no record."""
    r = records(spark, sf)
    targets = r.filter("pos % 3 = 0").select("chrom", "pos", letter(F.col("p_size")).alias("ref"), F.array(F.lit("T")).alias("alt"))
    out = annotate.constrained(r.filter("pos % 4 <> 0"), targets, insert_missed=True)
    return out.select("pos", "missed", F.get("wanted_index", F.lit(0)).alias("first"))


# Three sources with a sample each: which parts they have, and their ALT, go by the key. The second writes lower case, the third a REF of two
# bases; one in eleven rows of each has no ALT.
MERGED = """WITH s AS (SELECT p_partkey AS pos, k, substr('CGT', CAST((p_size + k * (p_partkey % 2)) % 3 AS INTEGER) + 1, 1) AS a, p_size + k AS q, CASE WHEN (p_partkey + k) % 5 = 0 THEN 'low' ELSE 'PASS' END AS f, (p_partkey + k) % 3 AS g, (p_partkey * 3 + k * 5) % 11 = 0 AS bare FROM part, (VALUES (0), (1), (2)) v(k) WHERE p_partkey % (k + 2) <> 0),
l AS (SELECT pos, bool_or(k = 2) AS long FROM s GROUP BY 1),
u AS (SELECT pos, a, min(k) AS first FROM s WHERE NOT bare GROUP BY 1, 2), r AS (SELECT pos, a, row_number() OVER (PARTITION BY pos ORDER BY first) AS i FROM u),
m AS (SELECT l.pos, CASE WHEN long THEN 'AT' ELSE 'A' END AS ref, coalesce(string_agg(a || CASE WHEN long THEN 'T' ELSE '' END, ',' ORDER BY i), '') AS alts FROM l LEFT JOIN r ON l.pos = r.pos GROUP BY 1, 2),
x AS (SELECT s.pos, s.k, CASE WHEN bare THEN '0/0' WHEN g = 0 THEN '0/' || i WHEN g = 1 THEN i || '/' || i ELSE './' || i END AS gt FROM s LEFT JOIN r ON s.pos = r.pos AND s.a = r.a) """


@register("merge_records", MERGED + "SELECT m.pos, m.ref, alts, CAST(max(q) AS DOUBLE) AS qual, CASE WHEN bool_or(f = 'low') THEN 'low' ELSE 'PASS' END AS filter, coalesce(max(CASE WHEN x.k = 0 THEN gt END), './.') AS g0, coalesce(max(CASE WHEN x.k = 1 THEN gt END), './.') AS g1, coalesce(max(CASE WHEN x.k = 2 THEN gt END), './.') AS g2 FROM m JOIN s ON m.pos = s.pos JOIN x ON x.pos = s.pos AND x.k = s.k GROUP BY m.pos, m.ref, alts")
def merge_records(spark, sf):
    from strandlake.functions.project import gt_text

    m = merge.merge_records([merge_source(spark, sf, k) for k in range(3)], [[f"s{k}"] for k in range(3)])
    return m.select("pos", "ref", F.array_join("alt", ",").alias("alts"), "qual", F.array_join("filters", ";").alias("filter"), *(gt_text(F.get("samples", F.lit(k))).alias(f"g{k}") for k in range(3)))


def merge_source(spark, sf, k):
    key, size = F.col("p_partkey"), F.col("p_size")
    alt = F.substr(F.lit("CGT"), ((size + k * (key % 2)) % 3).cast("int") + 1, F.lit(1))
    one, none, zero, bare = F.lit(1), F.lit(None).cast("int"), F.lit(0), (key * 3 + k * 5) % 11 == 0
    gt = F.when(bare, F.array(zero, zero)).when((key + k) % 3 == 0, F.array(zero, one)).when((key + k) % 3 == 1, F.array(one, one)).otherwise(F.array(none, one))
    ref, alt = [(F.lit("A"), alt), (F.lit("a"), F.lower(alt)), (F.lit("AT"), F.concat(alt, F.lit("T")))][k]
    alts = F.when(bare, F.array().cast("array<string>")).otherwise(F.array(alt))
    sample = F.struct(F.lit(f"s{k}").alias("sample"), gt.alias("gt"), F.lit(False).alias("phased"), F.array(size, size + 10).alias("AD"))
    return table(spark, sf, "part").filter(key % (k + 2) != 0).select(F.lit("1").alias("chrom"), key.alias("pos"), F.array().cast("array<string>").alias("id"), ref.alias("ref"), alts.alias("alt"), (size + k).cast("double").alias("qual"), F.array(F.when((key + k) % 5 == 0, "low").otherwise("PASS")).alias("filters"), F.array(sample).alias("samples"))


MERGED_VALUES = MERGED + """, d AS (SELECT s.pos, s.k, CAST(q - s.k AS INTEGER) AS base, bare, r.i FROM s LEFT JOIN r ON s.pos = r.pos AND s.a = r.a)
SELECT d.pos, CAST(d.k AS INTEGER) AS source, v.i AS place, CASE WHEN v.i = 0 THEN base WHEN v.i = d.i AND NOT bare THEN base + 10 ELSE 0 END AS value
FROM d, (VALUES (0), (1), (2), (3)) v(i) WHERE v.i <= (SELECT count(*) FROM r WHERE r.pos = d.pos)"""


@register("merge_values", MERGED_VALUES)
def merge_values(spark, sf):
    """Depths by allele of merged rows, 0 where a source does not know the allele."""
    rows = [merge_source(spark, sf, k) for k in range(3)]
    cut = lambda d: d.withColumn("samples", F.transform("samples", lambda s: s.withField("AD", F.slice(s["AD"], F.lit(1), F.size("alt") + 1))))
    m = merge.merge_records([cut(d) for d in rows], [[f"s{k}"] for k in range(3)], by_allele=("AD",), missing={"AD": 0})
    each = m.select("pos", F.posexplode("samples").alias("source", "s")).select("pos", "source", F.posexplode("s.AD").alias("place", "value"))
    return each


#: Genotypes that the filter language has no short word for: the text of a record's samples as codes and as a line.
CODES = """WITH f AS (SELECT l_partkey AS pos, l_suppkey % 6 AS s, min(l_orderkey * 8 + l_linenumber) AS k FROM lineitem GROUP BY 1, 2), g AS (SELECT pos, s, CAST(k % 2 AS INTEGER) AS a, CAST((k // 2) % 2 AS INTEGER) AS b, CAST(k % 40 AS BIGINT) AS dp FROM f) """


@register("format_functions", CODES + "SELECT 'c:' || pos || ' ' || CAST(sum(dp) AS BIGINT) || ' ' || CAST(count(*) FILTER (dp > 10) AS BIGINT) || ' ' || string_agg(CASE WHEN a = b THEN CASE a WHEN 0 THEN 'A' ELSE 'G' END ELSE 'R' END, '' ORDER BY s) AS line FROM g GROUP BY pos")
def format_functions(spark, sf):
    """A format with functions of the filter language and one-letter genotypes."""
    from strandlake.functions.project import Projector

    f = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % 6).alias("s")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    gt = F.array((F.col("k") % 2).cast("int"), (F.expr("k div 2") % 2).cast("int"))
    df = f.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("sample"), gt.alias("gt"), F.lit(False).alias("phased"), (F.col("k") % 40).alias("DP")))).alias("samples"))
    df = df.withColumns({"chrom": F.lit("c"), "ref": F.lit("A"), "alt": F.array(F.lit("G"))})
    return df.select(Projector(df).compile("%CHROM:%POS %SUM(FMT/DP) %N_PASS(FMT/DP>10) [%IUPACGT]").alias("line"))


#: Insertions and deletions of one to six bases at each part, on the contig of the parts' bases.
REPEATS = """WITH p AS (SELECT p_partkey + 1 AS pos, substr('ACGT', CAST(p_size % 4 AS INTEGER) + 1, 1) AS base, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE -1 END * CAST(1 + p_partkey % 6 AS INTEGER) AS change, p_size FROM part),
s AS (SELECT string_agg(base, '' ORDER BY pos) AS seq FROM p), t AS (SELECT pos, change, p_size, substr(seq, pos + 1, 50) AS after FROM p, s WHERE pos < length(seq)),
u AS (SELECT *, unnest(range(1, 11)) AS k FROM t), c AS (SELECT *, list_max(list_filter(range(1, 51), lambda j: starts_with(after, repeat(substr(after, 1, k), j)))) AS copies FROM u WHERE length(after) >= k),
b AS (SELECT pos, change, p_size, CAST(max((copies, k))[1] AS INTEGER) AS copies, CAST(max((copies, k))[2] AS INTEGER) AS unit FROM c GROUP BY pos, change, p_size),
x AS (SELECT *, CASE WHEN unit <= 1 OR copies <= 1 THEN 'none' WHEN change % unit = 0 THEN 'whole' ELSE 'broken' END AS context FROM b) """


def indel_context(spark, sf):
    from strandlake.operators import repeats

    key = F.col("p_partkey")
    n = (1 + key % 6).cast("int")
    p = table(spark, sf, "part").select(F.lit("c").alias("chrom"), (key + 1).alias("pos"), letter(F.col("p_size")).alias("base"), (key % 3 == 0).alias("gains"), n.alias("n"), "p_size")
    more = F.substring(F.lit("ACGTAC"), F.lit(1), F.col("n"))
    ref = F.when(F.col("gains"), F.col("base")).otherwise(F.concat("base", more))
    alt = F.when(F.col("gains"), F.concat("base", more)).otherwise(F.col("base"))
    return repeats.repeat_context(p.select("chrom", "pos", ref.alias("ref"), F.array(alt).alias("alt"), "p_size"), contig(spark, sf))


@register("indel_repeat_context", REPEATS + "SELECT pos, change, copies, unit, context FROM x")
def indel_repeat_context(spark, sf):
    return indel_context(spark, sf).filter("context IS NOT NULL").select("pos", "change", "copies", "unit", "context")


@register("indel_repeat_table", REPEATS + """, g AS (SELECT *, unnest([0.0, 10.0, 30.0]) AS at_least FROM x)
SELECT at_least::DOUBLE AS at_least, CASE WHEN context = 'none' THEN 0 ELSE unit END AS unit, count(*) FILTER (WHERE context = 'whole' AND change < 0) AS whole_lost, count(*) FILTER (WHERE context = 'broken' AND change < 0) AS broken_lost, count(*) FILTER (WHERE context = 'whole' AND change > 0) AS whole_gained, count(*) FILTER (WHERE context = 'broken' AND change > 0) AS broken_gained, count(*) FILTER (WHERE context = 'none') AS "none" FROM g WHERE p_size >= at_least GROUP BY 1, 2""")
def indel_repeat_table(spark, sf):
    from strandlake.operators import repeats

    return repeats.repeat_table(repeats.threshold_grid(indel_context(spark, sf), F.col("p_size"), [0, 10, 30]), "at_least")
