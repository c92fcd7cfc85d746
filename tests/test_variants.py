"""Variant operators on small tables that are written here."""

from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import stats_math as M
from strandlake.functions.expr import FilterError, compile_filter, compile_value, expand_grid
from strandlake.functions.project import Projector
from strandlake.operators import alleles, annotate, calling, cohorts, consequence, genotypes, hmm, merge, normalise, regions, sequential, setops, stats, variants
from strandlake.sources import text_formats as tf

VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all">
##INFO=<ID=AF1,Number=A,Type=Float,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
##contig=<ID=2>
##contig=<ID=1>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
1\t10\trs1;x\tA\tG,T\t50\tPASS\tDP=30;AF1=0.5,0.1;DB\tGT:DP:AD\t0/1:10:5,5,0\t1|2:20:0,9,11\t./.:.:.
1\t20\t.\tAC\tA\t.\t.\tDP=5\tGT:DP:AD\t0/0:3:3,0\t0/1:7:4,3\t1/1:.:0,2
2\t5\t.\tC\t<*>\t9.5\tq10;s50\tAF1=.\tGT:DP:AD\t0|0:1:1,0\t0:2:2,0\t.:.:.
"""


@pytest.fixture(scope="module")
def vcf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("v") / "x.vcf"
    path.write_text(VCF)
    return tf.read_vcf(spark, str(path)).cache(), tf.read_header(spark, str(path))


def sites(df):
    return sorted((r.chrom, r.pos) for r in df.select("chrom", "pos").collect())


def test_vcf_round_trip(spark, vcf, tmp_path):
    df, h = vcf
    assert h.samples == ["s1", "s2", "s3"] and h.contigs == ["2", "1"]
    r = {x.pos: x for x in df.collect()}
    assert r[10].info.DP == 30 and r[10].info.DB and r[10].info.AF1 == [0.5, 0.1] and r[10].samples[1].gt == [1, 2] and r[10].samples[1].phased
    assert r[20].id == [] and r[20].qual is None and r[20].samples[2].AD == [0, 2] and r[20].samples[2].DP is None
    lines = [x.value for x in tf.vcf_lines(tf.sort_sites(df, h.contigs)).collect()]
    want = [x for x in VCF.split("\n") if x and x[0] != "#"]
    drop = lambda s: s.replace("AF1=.", ".").replace(".:.:.", "./.:.:.") if s.startswith("2") else s
    odd = tmp_path / "odd.vcf"
    odd.write_text(VCF.split("#CHROM")[0] + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t7\t.\tA\tC\t.\t.\tDP=3;NEW=1,2;FLAG\tGT:XX:DP:AD:YY\t0/1:a:3:1,2:q\t1|1:.:4:0,4:r\n")
    o = tf.read_vcf(spark, str(odd))
    assert o.first().info_more == {"NEW": "1,2", "FLAG": None} and o.first().samples[0].more == {"XX": "a", "YY": "q"}
    assert tf.vcf_lines(o).first().value == "1\t7\t.\tA\tC\t.\t.\tDP=3;NEW=1,2;FLAG\tGT:DP:AD:XX:YY\t0/1:3:1,2:a:q\t1|1:4:0,4:.:r"
    assert lines[1] == want[0] and lines[2] == want[1] and lines[0].split("\t")[:7] == drop(want[2]).split("\t")[:7]
    tf.write_vcf(df, h, str(tmp_path / "out"))
    assert sites(tf.read_vcf(spark, str(tmp_path / "out"), h)) == sites(df)


@pytest.mark.parametrize(
    "expr,want",
    [
        ("QUAL>20", [10]), ('QUAL="."', [20]), ("QUAL!=50", [5, 20]), ("INFO/DP>=5 && QUAL>20", [10]), ("INFO/AF1=0.1", [10]), ("INFO/AF1!=0.5", [5, 10, 20]),
        ("FMT/DP>15", [10]), ("FMT/DP>5 & FMT/AD[*:1]>4", [10]), ('GT="het"', [10, 20]), ('GT="mis"', [5, 10]), ('GT="1/1"', [20]), ("N_PASS(FMT/DP>2)=2", [10, 20]), ("N_ALT=2", [10]),
        ("F_MISSING>0.3", [5, 10]), ("AC[0]=2", [10]), ("AN=6", [20]), ("MAX(FMT/DP)=20", [10]), ("SMPL_SUM(FMT/AD)=10", [10]), ("ILEN=-1", [20]), ('ID="rs1"', [10]), ("DB=1", [10]),
        ("COUNT(FMT/DP)<3 || QUAL>20", [5, 10, 20]), ("(QUAL<10)", [5]), ("POS-5*2<=0", [5, 10]),
        ('FILTER="PASS"', [10]), ('FILTER="."', [20]), ('FILTER!="PASS"', [5, 20]), ('FILTER="s50;q10"', [5]), ('FILTER="q10"', []), ('FILTER~"q10"', [5]), ('FILTER!~"q10"', [10, 20]),
        ('TYPE="snp"', [10]), ('TYPE="indel"', [20]), ('TYPE~"snps"', [10]), ('TYPE="ref"', [5]), ('TYPE!="snp"', [5, 20]), ('TYPE~"snp,indel"', [10, 20]),
        ("FMT/AD[GT]>10", [10]), ("FMT/AD[1:GT]=9", [10]), ("FMT/AD[0:GT]=9", []), ("BINOM(FMT/AD)<0.9", [10]), ("FISHER(FMT/AD[*:0-1],FMT/AD[*:0-1])<=1", [5, 10, 20]),
    ],
)
def test_filter_expressions(vcf, expr, want):
    df, _ = vcf
    assert sorted(r.pos for r in compile_filter(expr, df).keep(df).collect()) == want


def test_lists_bound_values_and_functions(spark, vcf, tmp_path):
    df, _ = vcf
    (tmp_path / "names.txt").write_text("s2\ns3\n")
    hits = lambda e, **k: sorted(r.pos for r in compile_filter(e, df, **k).keep(df).collect())
    assert hits(f"FMT/DP[@{tmp_path}/names.txt] > 6") == [10, 20] and hits(f"FMT/AD[@{tmp_path}/names.txt:0]=4") == [20]
    assert hits('GT[@some]="het"', sets={"some": ["s1"]}) == [10]
    assert hits("POS={INT} || ID={STR}", bound=[F.lit(20), F.lit("rs1")]) == [10, 20]
    assert hits("py.twice(QUAL) > 90", functions={"twice": lambda c: c * 2}) == [10]
    for bad in ('FILTER>1', 'TYPE="nothing"', "QUAL[GT]>1", "POS={INT}", "py.none(QUAL)>1"):
        with pytest.raises(FilterError):
            compile_filter(bad, df)


def test_grouping_to_the_right_and_errors(vcf):
    df, _ = vcf
    v = lambda e, **k: df.limit(1).select(compile_value(e, df, **k).alias("v")).first().v
    assert v("10-3-2") == 5 and v("10-3-2", compat=True) == 9 and v("8/4/2", compat=True) == 4 and v("-2*3") == -6
    for bad in ("NOPE>1", "QUAL>", "1 +* 2", "DP>1", "(QUAL>1"):
        with pytest.raises((FilterError, ValueError)):
            compile_filter(bad, df)
    assert expand_grid("a>{1,2} && b<{3,4}") == ["a>1 && b<3", "a>1 && b<4", "a>2 && b<3", "a>2 && b<4"]


def test_masks(vcf):
    df, _ = vcf
    m = lambda e: {r.pos: r.m for r in df.select("pos", compile_filter(e, df).mask.alias("m")).collect()}
    assert m("FMT/DP>5 & FMT/DP<15")[10] == [True, False, False]
    assert m("FMT/DP<15 | FMT/DP>15")[10] == [True, True, False]
    assert m("FMT/DP<15 || FMT/DP>100")[10] == [True, True, True]
    assert m("QUAL>20 || FMT/DP=3")[20] == [True, False, False]
    assert sorted(r.pos for r in compile_filter("FMT/DP>2", df).drop(df).collect()) == [5, 10, 20]


def test_projection(vcf):
    df, _ = vcf
    line = lambda f, **k: {r.pos: r.l for r in df.select("pos", Projector(df, **k).compile(f).alias("l")).collect()}
    assert line(r"%CHROM:%POS0-%END %REF>%ALT{0} %ID %QUAL %FILTER\n")[10] == "1:9-10 A>G rs1,x 50 PASS\n"
    assert line("[%SAMPLE=%GT;]")[10] == "s1=0/1;s2=1|2;s3=./.;"
    assert line("[%TGT %AD{1} %/QUAL,]")[10] == "A/G 5 50,G|T 9 50,./. . 50,"
    assert line("%TYPE")[10] == "SNP" and line("%TYPE")[5] == "REF" and line("%INFO")[10] == "DP=30;AF1=0.5,0.1;DB" and line("%INFO")[5] == "."
    assert line("[%IUPACGT ]")[10] == "R K ./. " and line("[%IUPACGT ]")[20] == "AC/AC AC/A A "
    assert line("%N_PASS(FMT/DP>2) %SUM(FMT/AD) [%SMPL_SUM(FMT/AD);]")[20] == "2 12 3;7;2;"
    assert line("[%PBINOM(AD),]")[20] == "0,0,0," and line("[%PBINOM(AD),]")[10].split(",")[0] == "0"
    assert line("%LINE")[20].startswith("1\t20\t.\tAC\tA\t.\t.\tDP=5\tGT:DP:AD\t0/0:3:3,0\t")
    assert Projector(df).header("%CHROM %N_PASS(FMT/DP>2)[ %GT]") == "#[1]CHROM\t[2]N_PASS(FMT/DP>2)\t[3]GT" and Projector(df).header("%CHROM", False) == "#CHROM"
    assert line("%INFO/DP %DB %IS_TS")[10] == "30 true 1" and line("%NO", undefined=True)[5] == "."


def test_views(vcf):
    df, _ = vcf
    v = lambda **k: [p for _, p in sites(variants.view(df, **k))]
    assert v(min_alleles=3) == [10] and v(max_alleles=2) == [20, 5] and v(known=True) == [10] and v(types=["indel"]) == [20] and v(not_types=["snp"]) == [20, 5]
    assert v(filters=["q10"]) == [5] and v(filters=["PASS", "."]) == [10, 20] and v(genotype="het") == [10, 20] and v(genotype="^miss") == [20] and v(phased=True) == [5]
    assert v(ac=(3, None, "nref")) == [10, 20] and v(af=(None, 0.1, "nref")) == [5] and v(uncalled=True) == []
    assert [p for _, p in sites(variants.private_to(df, ["s3"]))] == [] and [s.sample for s in variants.subset_samples(df, ["s3", "s1"]).first().samples] == ["s3", "s1"]
    t = {r.pos: r for r in variants.trim_alts(variants.subset_samples(df, ["s1"]), ()).collect()}
    assert t[10].alt == ["G"] and t[10].samples[0].gt == [0, 1] and t[20].alt == []
    m = {r.pos: [s.gt for s in r.samples] for r in variants.missing_to_ref(df).collect()}
    assert m[10][2] == [0, 0]
    assert {r.pos: r.filters for r in variants.soft_filter(df, F.col("qual") > 20, "low").collect()} == {10: ["PASS"], 20: ["low"], 5: ["q10", "s50", "low"]}


def test_exact_tests(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(M.fisher_exact(F.lit(3), F.lit(1), F.lit(1), F.lit(3))) == pytest.approx(0.485714, abs=1e-5)
    assert one(M.fisher_exact(F.lit(40), F.lit(10), F.lit(12), F.lit(38))) == pytest.approx(3.0e-8, rel=0.5)
    assert one(M.binom_two_sided(F.lit(2), F.lit(8))) == pytest.approx(0.109375, abs=1e-9)
    assert one(M.log_factorial(F.lit(100))) == pytest.approx(363.73937555556, abs=1e-8)
    for ref, alt, het in [(10, 10, 10), (10, 10, 4), (21, 5, 3), (30, 12, 0), (7, 7, 7), (5, 0, 0)]:
        rare, n = min(ref, alt), (ref + alt) // 2
        ways = {h: factorial(n) // (factorial(h) * factorial((ref - h) // 2) * factorial((alt - h) // 2)) * 2**h for h in range(rare % 2, rare + 1, 2)}
        want = sum(w for w in ways.values() if w <= ways[het]) / sum(ways.values()), sum(w for h, w in ways.items() if h >= het) / sum(ways.values())
        assert (one(M.hwe_exact(*map(F.lit, (ref, alt, het)))[0]), one(M.hwe_exact(*map(F.lit, (ref, alt, het)))[1])) == pytest.approx(want, abs=1e-9)
    assert one(M.genotype_index(F.lit(2), F.lit(1))) == 4


def test_interval_operators(spark):
    rng = np.random.default_rng(3)
    mk = lambda n, p: [(f"c{i % 2}", int(b), int(b + rng.choice([0, 3, 40, 900])), i) for i, b in enumerate(rng.integers(1, 3000, n))]
    a, b = mk(60, "a"), mk(50, "b")
    A, B = spark.createDataFrame(a, "c string, x long, y long, i int"), spark.createDataFrame(b, "d string, s long, e long, j int")
    over = lambda p, q: p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2]
    j = lambda how: regions.overlap_join(A, B, [("c", "d")], ("x", "y"), ("s", "e"), how)
    assert sorted((r.i, r.j) for r in j("inner").collect()) == sorted((p[3], q[3]) for p in a for q in b if over(p, q))
    hit = {p[3] for p in a if any(over(p, q) for q in b)}
    assert sorted(r.i for r in j("left_semi").collect()) == sorted(hit)
    assert sorted(r.i for r in j("left_anti").collect()) == sorted({p[3] for p in a} - hit)
    assert {r.i for r in j("left").filter("j IS NULL").collect()} == {p[3] for p in a} - hit
    m = regions.merge_intervals(spark.createDataFrame([("c", 1, 5), ("c", 5, 7), ("c", 8, 9)], "c string, b long, e long"), ["c"], "b", "e")
    assert sorted((r.b, r.e, r.n) for r in m.collect()) == [(1, 7, 2), (8, 9, 1)]
    d = regions.nearest_distance(spark.createDataFrame([("c", p) for p in (1, 5, 5, 20)], "c string, p long"), ["c"], "p").collect()
    assert sorted((r.p, r.dist_rev, r.dist_fwd, r.dist_nearest) for r in d if r.p > 1) == [(5, 4, 15, 4), (5, 4, 15, 4), (20, 15, None, 15)]
    i = regions.interpolate(spark.createDataFrame([("c", p) for p in (0, 10, 15, 30)], "c string, p long"), spark.createDataFrame([("c", 10, 1.0), ("c", 20, 3.0)], "c string, p long, v double"), ["c"], "p", "v")
    assert {r.p: r.v_at for r in i.collect()} == {0: 1.0, 10: 1.0, 15: 2.0, 30: 3.0}


def test_intervals_that_end_before_they_begin(spark):
    A = spark.createDataFrame([("c", 1, 5, 1), ("c", 9, 3, 2), ("c", None, 3, 3), ("c", 1, 2_000_000, 4), ("c", 900, 901, 5)], "c string, x long, y long, i int")
    B = spark.createDataFrame([("c", 4, 4, 7), ("c", 8, 2, 8), ("c", 1_500_000, 1_500_001, 9)], "d string, s long, e long, j int")
    j = lambda how: regions.overlap_join(A, B, [("c", "d")], ("x", "y"), ("s", "e"), how)
    assert sorted(r.i for r in j("left_anti").collect()) == [2, 3, 5]
    assert sorted(r.i for r in j("left_semi").collect()) == [1, 4]
    assert sorted((r.i, r.j or 0) for r in j("left").collect()) == [(1, 7), (2, 0), (3, 0), (4, 7), (4, 9), (5, 0)]
    assert sorted((r.i, r.j) for r in j("inner").collect()) == [(1, 7), (4, 7), (4, 9)]


def test_regions_text(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\n1\t9\t20\n2 0 1\n")
    (tmp_path / "b.txt").write_text("1\t10\n1\t5\t6\n")
    (tmp_path / "c.reg").write_text("1:1,000-2000\n2\n3:7\n4:8-\n")
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(tf.read_regions(spark, str(tmp_path / "a.bed"))) == [("1", 10, 20), ("2", 1, 1)]
    assert rows(tf.read_regions(spark, str(tmp_path / "b.txt"))) == [("1", 10, 10), ("1", 5, 6)]
    assert rows(tf.read_regions(spark, str(tmp_path / "c.reg"), "reg")) == [("1", 1000, 2000), ("2", 1, 2147483646), ("3", 7, 7), ("4", 8, 2147483646)]


def test_alleles(spark):
    ref = "GGGACACACACTTT"
    assert alleles.trim_left_align(9, ["CAC", "C"], ref) == (3, ["GAC", "G"])
    assert alleles.trim_left_align(4, ["ACA", "GCA"], ref) == (4, ["A", "G"])
    assert alleles.trim_left_align(1, ["GG", "G"], ref) == (1, ["GG", "G"]) and alleles.trim_left_align(5, ["C", "<DEL>"], ref) == (5, ["C", "<DEL>"])
    assert alleles.atoms(5, "ACG", "TCA") == [(5, "A", "T"), (7, "G", "A")] and alleles.atoms(5, "A", "AT") == [(5, "A", "AT")] and alleles.atoms(5, "CA", "GAA") == [(5, "C", "G"), (5, "C", "CA")]
    assert alleles.merge_alleles("A", ["G"], "AC", ["A"]) == ("AC", ["GC", "A"])
    df = spark.createDataFrame([("1", 10, "A", ["G", "T"], [0.1, 0.2], [5, 6, 7], [1, 2])], "chrom string, pos long, ref string, alt array<string>, af array<double>, ad array<int>, gt array<int>")
    s = [(r.alt, r.af, r.ad, r.gt) for r in alleles.split_rows(df, by_alt=("af",), by_allele=("ad",), gt="gt").orderBy("alt_index").collect()]
    assert s == [(["G"], [0.1], [5, 6], [1, 0]), (["T"], [0.2], [5, 7], [0, 1])]
    back = alleles.join_rows(alleles.split_rows(df).select("chrom", "pos", "ref", F.get("alt", F.lit(0)).alias("alt")), ["chrom", "pos", "ref"], "alt").first()
    assert back.alt == ["G", "T"]
    left = normalise.left_align(spark.createDataFrame([("1", 9, "CAC", ["C"])], "chrom string, pos long, ref string, alt array<string>"), spark.createDataFrame([("1", ref)], "chrom string, seq string")).first()
    assert (left.pos, left.ref, left.alt) == (3, "GAC", ["G"])
    types = ["A>G", "A>A", "AC>A", "AC>GT", "A><*>", "A>*", "A><DEL>", "A>G[1:5["]
    got = spark.createDataFrame([t.split(">", 1) for t in types], "r string, a string").select(alleles.variant_type(F.col("r"), F.col("a")).alias("t")).collect()
    assert [r.t for r in got] == ["snp", "ref", "indel", "mnp", "ref", "overlap", "other", "bnd"]


def test_left_alignment_in_rounds(spark):
    ref = "G" + "CA" * 3000 + "TTT"  # longer than a tile
    rows = [("1", 5990, "CAC", ["C"]), ("1", 11, "C", ["<DEL>"]), ("9", 5, "A", ["AT"])]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt array<string>")
    out = {(r.chrom, r.ref): (r.pos, r.alt) for r in normalise.left_align(df, spark.createDataFrame([("1", ref)], "chrom string, seq string"), window=700).collect()}
    assert out == {("1", "GCA"): (1, ["G"]), ("1", "C"): (11, ["<DEL>"]), ("9", "A"): (5, ["AT"])}


def test_reference_checks(spark):
    fasta = spark.createDataFrame([("1", "ACGTN" + "A" * 5000)], "chrom string, seq string")
    rows = [("1", 1, "A", ["C"], [0, 1]), ("1", 2, "G", ["C"], [0, 1]), ("1", 3, "R", ["A"], [1, 1]), ("1", 5, "T", ["A"], [0, 0]), ("7", 1, "A", ["C"], [0, 0]), ("1", 4, "A", ["C"], [None, 1]), ("1", 4095, "AAAA", ["A"], [0, 1])]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt array<string>, gt array<int>").withColumn("samples", F.array(F.struct(F.lit("s").alias("sample"), "gt"))).drop("gt")
    ok = {(r.chrom, r.pos): r.ref_ok for r in normalise.check_ref(df, fasta).collect()}
    assert ok == {("1", 1): True, ("1", 2): False, ("1", 3): True, ("1", 5): True, ("7", 1): None, ("1", 4): False, ("1", 4095): True}
    assert normalise.check_ref(df, fasta, "x").count() == 5
    fixed = {(r.chrom, r.pos): (r.ref, r.alt, r.samples[0].gt) for r in normalise.check_ref(df, fasta, "s").collect()}
    assert fixed[("1", 2)] == ("C", ["G"], [1, 0]) and fixed[("1", 4)] == ("T", ["C"], [None, 1]) and fixed[("1", 1)] == ("A", ["C"], [0, 1])
    with pytest.raises(Exception, match="REF differs"):
        normalise.check_ref(df, fasta, "e").collect()
    snps = spark.createDataFrame([("1", 1, "C", ["A"]), ("1", 2, "G", ["T"]), ("1", 3, "A", ["C"]), ("1", 4, "T", ["A"]), ("1", 2, "A", ["G"]), ("1", 1, "A", ["T"]), ("1", 2, "C", ["G"])], "chrom string, pos long, ref string, alt array<string>").withColumn("samples", F.array(F.struct(F.lit("s").alias("sample"), F.array(F.lit(0), F.lit(1), F.lit(1)).alias("gt"))))
    got = sorted((r.fixref, r.ref, r.alt, r.samples[0].gt) for r in normalise.fix_ref(snps, fasta).collect())
    assert got == sorted([("ok", "A", ["T"], [0, 1, 1]), ("swap", "A", ["C"], [1, 0, 0]), ("flip+swap", "C", ["T"], [1, 0, 0]), ("ok", "C", ["G"], [0, 1, 1]), ("flip", "C", ["A"], [0, 1, 1]), ("flip+swap", "G", ["T"], [1, 0, 0]), ("ok", "T", ["A"], [0, 1, 1])])
    assert {r.fixref for r in normalise.fix_ref(snps, fasta, "stats").collect()} == {"ok", "swap", "flip", "flip+swap"}
    some = normalise.only_where(df, F.col("pos") > 3, lambda x: x.withColumn("ref", F.lit("Z")))
    assert sorted((r.pos, r.ref) for r in some.collect()) == [(1, "A"), (1, "A"), (2, "G"), (3, "R"), (4, "Z"), (5, "Z"), (4095, "Z")]


def test_annotation_and_names(spark, vcf):
    df, _ = vcf
    ann = spark.createDataFrame([("1", 10, "A", "T,C", 7, "late"), ("1", 10, "A", "g", 5, "early"), ("1", 20, "AC", "G", 1, "no")], "chrom string, pos long, ref string, alt string, k int, note string")
    got = {r.pos: r.note for r in annotate.by_alleles(df, ann, {"note": "note"}, order=["k"]).collect()}
    assert got == {10: "early", 20: None, 5: None}
    assert {r.pos: r.note for r in annotate.by_alleles(df, ann, {"note": "note"}, order=["k"], extra='ann_note="late"').collect()}[10] == "late"
    other = df.withColumn("mark", F.col("pos") + 1).withColumn("alt", F.array(F.lit("T")))
    assert {r.pos: r.m for r in annotate.by_record(df, other, {"mark": "m"}, "some").collect()} == {10: 11, 20: None, 5: None}
    assert {r.pos: r.m for r in annotate.by_record(df, other, {"mark": "m"}, "snps").collect()} == {10: 11, 20: None, 5: None}
    assert {r.pos: r.m for r in annotate.by_record(df, other, {"mark": "m"}, "id").filter("pos = 10").collect()} == {10: 11}
    assert {s.sample for s in annotate.rename_samples(df, {"s1": "new"}).first().samples} == {"new", "s2", "s3"}
    assert "DEPTH" in annotate.rename_fields(df, {"DP": "DEPTH"}, "info").schema["info"].dataType.fieldNames()


def test_order_dependent_operators(spark):
    df = spark.createDataFrame([("1", p, v) for p, v in [(1, 0.5), (2, 0.1), (3, 0.9), (50, 0.2), (51, 0.3)]], "c string, p long, v double")
    assert sorted(r.p for r in sequential.prune(df, ["c"], "p", 2, 10, "v").collect()) == [1, 3, 50, 51]
    assert sorted(r.p for r in sequential.prune(df, ["c"], "p", 1, 10).collect()) == [1, 50]
    iv = spark.createDataFrame([("1", 1, 5, 9.0), ("1", 4, 8, 1.0), ("1", 8, 9, 5.0), ("1", 20, 21, 0.0)], "c string, b long, e long, q double")
    f = lambda how: sorted(r.b for r in sequential.mark_overlaps(iv, ["c"], "b", "e", how, "q").filter("overlap").collect())
    assert f("overlap") == [1, 4, 8] and f("dup") == [] and f("min") == [4]
    d = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.8), ("c", "d", 0.2), ("a", "d", 1.0), ("b", "d", 1.0)], "a string, b string, d double")
    assert {r["sample"]: r.cluster for r in sequential.cluster_samples(d, "a", "b", "d").collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    s = spark.createDataFrame([(s, n, v) for s, vs in (("x", "001"), ("y", "010"), ("z", "000")) for n, v in zip("abc", vs)], "site string, n string, v string")
    assert [(r.site, r.new_pairs, r.covered) for r in sequential.distinctive_blocks(s, "site", "n", "v", 10).collect()] == [("x", 2, 2), ("y", 1, 3)]
    b = spark.createDataFrame([("1", p, dp) for p, dp in [(1, 5), (2, 6), (3, 12), (5, 12), (6, 1)]], "c string, p long, dp int")
    assert sorted((r.beg, r.end, r.min_depth) for r in sequential.depth_blocks(b, ["c"], "p", "dp", [2, 10]).collect()) == [(1, 2, 5), (3, 3, 12), (5, 5, 12)]


def test_viterbi(spark):
    pos, t, init = np.arange(1, 9), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5])
    emit = np.array([[0.9, 0.1]] * 4 + [[0.1, 0.9]] * 4)
    import itertools

    score = lambda path: init[path[0]] * np.prod([emit[i, s] for i, s in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
    best = max(itertools.product((0, 1), repeat=8), key=score)
    assert tuple(hmm.viterbi(pos, emit, t, init)) == best
    p = hmm.posterior(pos, emit, t, init)
    whole = {q: score(q) for q in itertools.product((0, 1), repeat=8)}
    assert p[3, 0] == pytest.approx(sum(v for q, v in whole.items() if q[3] == 0) / sum(whole.values()))
    gap = hmm.viterbi(np.array([1, 6]), np.array([[1, 0], [0.5, 0.5]]), np.array([[0.6, 0.4], [0.5, 0.5]]), init)
    assert gap.tolist() == [0, int(np.argmax(np.linalg.matrix_power(np.array([[0.6, 0.4], [0.5, 0.5]]), 5)[0]))]
    df = spark.createDataFrame([("g", int(i), float(a), float(b)) for i, (a, b) in zip(pos, emit)], "g string, p long, a double, b double")
    assert [r.state for r in hmm.decode(df, ["g"], "p", ["a", "b"], t.tolist(), [0.5, 0.5]).orderBy("p").collect()] == list(best)


def test_calls(spark):
    het, ref, alt, none = [30, 0, 40], [0, 30, 200], [200, 30, 0], [0, 0, 0]
    c = calling.multiallelic_call(np.array([het, ref, alt, none]), np.array([0.5, 0.5]))
    assert c["alleles"] == [0, 1] and c["gt"] == [(0, 1), (0, 0), (1, 1), (-1, -1)] and c["qual"] > 20
    assert calling.multiallelic_call(np.array([ref, ref]), np.array([1.0, 0.0]))["alleles"] == [0]
    df = spark.createDataFrame([("1", 5, [[90, 0, 90], ref], [0.6, 0.4])], "chrom string, pos long, pl array<array<int>>, qs array<double>")
    assert calling.call_sites(df).first().gt == [[0, 1], [0, 0]]
    assert calling.de_novo_score([60, 0, 60], [0, 60, 200], [0, 60, 200]) > calling.de_novo_score([60, 0, 60], [60, 0, 60], [0, 60, 200]) >= 0
    assert calling.genotype_likelihoods(["A", "G", "A", "G"], [30] * 4, ["A", "G"]).argmin() == 1


def test_pileup(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tx\nr1\t0\t1\t3\t60\t2S3M1D2M\t*\t0\t0\tTTACGTA\tIIIIIII\tRG:Z:a\nr2\t16\t1\t4\t60\t3M\t*\t0\t0\tCGT\tII!\nr3\t1024\t1\t4\t60\t3M\t*\t0\t0\tCGT\tIII\n")
    p = calling.pileup(calling.read_sam(spark, str(tmp_path / "x.sam")))
    assert sorted((r.pos, r["sample"], r.base, r.reverse) for r in p.collect()) == [(3, "a", "A", False), (4, "a", "C", False), (4, "sample", "C", True), (5, "a", "G", False), (5, "sample", "G", True), (7, "a", "T", False), (8, "a", "A", False)]
    d = calling.allele_depths(p, spark.createDataFrame([("1", "AAACGTTA")], "chrom string, seq string"))
    assert {(r.pos, r.base): (r.ref, r.depth) for r in d.filter("sample = 'a'").collect()}[4, "C"] == ("C", 1)


def test_consensus(spark):
    seq, chain = calling.apply_variants("ACGTACGT", [(2, "C", "T"), (4, "TA", "T"), (5, "A", "G"), (7, "G", "GAA")])
    assert seq == "ATGTCGAAT" and chain == [(4, 1, 0), (2, 0, 2), (1, 0, 0)]
    v = spark.createDataFrame([("1", 2, "C", ["T"], [0, 1]), ("1", 5, "A", ["G"], [1, 1])], "chrom string, pos long, ref string, alt array<string>, gt array<int>")
    f = spark.createDataFrame([("1", "ACGTACGT"), ("2", "AA")], "chrom string, seq string")
    c = lambda h: {r.chrom: r.seq for r in calling.consensus(v, f, h).collect()}
    assert c("R") == {"1": "ACGTGCGT", "2": "AA"} and c("A")["1"] == "ATGTGCGT" and c("I")["1"] == "AYGTGCGT" and c("1")["1"] == "ACGTGCGT"


def test_consequences(spark, tmp_path):
    (tmp_path / "g.gff").write_text("1\tx\ttranscript\t1\t40\t.\t+\t.\tID=transcript:T;Parent=gene:G;biotype=protein_coding\n1\tx\tCDS\t4\t12\t.\t+\t0\tParent=transcript:T\n1\tx\tCDS\t21\t26\t.\t+\t0\tParent=transcript:T\n1\tx\ttranscript\t50\t60\t.\t-\t.\tID=transcript:R;biotype=protein_coding\n1\tx\tCDS\t52\t57\t.\t-\t0\tParent=transcript:R\n")
    #      1  4        13      21    27                       52
    seq = "GGG" + "ATGGCATTA" + "GTAAAAAG" + "TGCTAA" + "C" * 25 + "TTACAT" + "C" * 10
    (tmp_path / "f.fa").write_text(">1 x\n" + seq[:30] + "\n" + seq[30:] + "\n")
    gff, fa = tf.read_gff(spark, str(tmp_path / "g.gff")), tf.read_fasta(spark, str(tmp_path / "f.fa"))
    assert {r.transcript: r.cds for r in consequence.coding_sequences(gff, fa).collect()} == {"T": "ATGGCATTATGCTAA", "R": "ATGTAA"}
    v = [(4, "A", "G"), (8, "C", "A"), (9, "A", "G"), (13, "G", "A"), (20, "G", "A"), (16, "A", "T"), (23, "C", "A"), (9, "A", "AT"), (9, "A", "ATTT"), (2, "G", "A"), (30, "C", "A"), (45, "C", "A"), (55, "C", "T"), (17, "A", "<DEL>")]
    df = spark.createDataFrame([("1", p, r, [a]) for p, r, a in v], "chrom string, pos long, ref string, alt array<string>")
    got = {(r.pos, r.alt): (r.consequence, r.aa) for r in consequence.local_consequences(df, gff, fa).collect()}
    assert got[4, "G"] == ("start_lost", "1M>1V") and got[8, "A"] == ("missense", "2A>2E") and got[9, "G"] == ("synonymous", "2A") and got[23, "A"] == ("stop_gained", "4C>4*")
    assert got[13, "A"][0] == "splice_donor" and got[20, "A"][0] == "splice_acceptor" and got[16, "T"][0] == "splice_region" and got[9, "AT"][0] == "frameshift" and got[9, "ATTT"][0] == "inframe_insertion"
    assert got[2, "A"][0] == "5_prime_utr" and got[30, "A"][0] == "3_prime_utr" and got[45, "A"][0] == "intergenic" and got[55, "T"] == ("start_lost", "1M>1I") and got[17, "<DEL>"][0] is None


def test_packed_consequences(spark):
    df = spark.createDataFrame([(1, "intron_variant|G1|,missense_variant&splice_region_variant|G2|YES,stop_gained|G3|")], "k int, csq string")
    r = consequence.split_packed(df, F.col("csq"), ["csq_type", "gene", "canonical"]).first()
    assert r.gene == ["G1", "G2", "G3"] and r.canonical == [None, "YES", None]
    each = consequence.split_packed(df, F.col("csq"), ["csq_type", "gene", "canonical"], True).withColumn("_order", F.monotonically_increasing_id())
    assert consequence.select_transcript(each, ["k"], "csq_type").first().gene == "G3"
    assert [x.gene for x in consequence.select_transcript(each, ["k"], "csq_type", "primary", "canonical").collect()] == ["G2"]
    assert sorted(x.gene for x in consequence.select_transcript(each, ["k"], "csq_type", "all", None, "missense").collect()) == ["G2", "G3"]


def test_cohorts(spark):
    rows = [(1, "k", [0, 1]), (1, "f", [0, 0]), (1, "m", [0, 1]), (2, "k", [0, 1]), (2, "f", [0, 0]), (2, "m", [0, 0]), (3, "k", [None, None]), (3, "f", [1, 1]), (3, "m", [0, 1]), (4, "k", [1]), (4, "f", [1, 1]), (4, "m", [0, 1])]
    g = spark.createDataFrame(rows, "pos int, sample string, gt array<int>")
    trios = spark.createDataFrame([("k", "f", "m")], "child string, father string, mother string")
    t = cohorts.trio_table(g, ["pos"], trios)
    got = cohorts.trio_stats(t).first()
    assert (got.good, got.error, got.missing, got.transmitted) == (1, 1, 2, 1)
    c = {r.pos: r for r in cohorts.contrast(g, ["pos"], ["k"], ["f", "m"]).collect()}
    assert c[2].NOVELAL == ["k"] and c[1].NOVELAL == [] and (c[1].case_alt, c[1].control_alt) == (1, 1)
    assert {r["mask"]: r.n for r in cohorts.shared_subsets(g, ["pos"], ["k", "f", "m"]).collect()} == {5: 1, 2: 3, 1: 2, 6: 1, 4: 2}
    assert [r.pos for r in cohorts.exclusive_genotype(g, ["pos"], ["k"]).collect()] == [2, 4]
    p = {r["sample"]: (r.alt_hom, r.het, r.missing, r.haploid) for r in cohorts.per_sample(g).collect()}
    assert p == {"k": (0, 2, 1, 1), "f": (2, 0, 0, 0), "m": (0, 3, 0, 0)}
    b = spark.createDataFrame([(1, "k", [1, 1]), (2, "k", [1, 0])], "pos int, sample string, gt array<int>")
    same = {(r.pos): r.gt for r in cohorts.identical_or_missing(g.filter("sample = 'k'"), b, ["pos", "sample"]).collect()}
    assert same[1] == [None, None] and same[2] == [0, 1] and same[4] == [1]
    s = spark.createDataFrame([("a", 1, [0, 1], [1, 0]), ("a", 1, [0, 1], [1, 0]), ("a", 2, [0, 1], [0, 1]), ("a", 3, [1, 0], [0, 1])], "sample string, chunk int, a array<int>, b array<int>")
    assert [r.swap for r in cohorts.ligation_swaps(s).orderBy("chunk").collect()] == [True, True, False]
    tags = stats.biallelic(stats.fill_tags(g, ["pos"])).filter("pos = 1").first()
    assert (tags.AN, tags.AC, tags.AC_Het, tags.AF) == (6, 2, 2, pytest.approx(1 / 3))


def test_sets(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 3], [2, 3, 4], [3, 5]))
    ks = lambda df: sorted(r.k for r in df.collect())
    assert ks(setops.isec([a, b, c], ["k"], "=2")) == [2] and ks(setops.isec([a, b, c], ["k"], "+2")) == [2, 3] and ks(setops.isec([a, b, c], ["k"], "~100")) == [1] and ks(setops.complement([a, b, c], ["k"])) == [1]
    assert sorted((r.k, r.src) for r in setops.concat([a, b], ["k"]).collect()) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    m = setops.merge_rows([spark.createDataFrame([(1, 2), (1, None)], "k int, v int"), spark.createDataFrame([(1, 4)], "k int, v int")], ["k"], {"v": "avg"}).first()
    assert m.v_avg == 2.0  # missing counts as nought, over three records


def test_scatter_of_wide_rows(spark):
    df = spark.range(20_000).select("id", F.hash("id").alias("h"), F.sha2(F.col("id").cast("string"), 256).alias("wide")).repartition(23)
    out = setops.scatter(df, 700, F.col("h"), F.col("id")).collect()
    want = {r.id: k // 700 for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.h, r.id)))}
    assert len(out) == 20_000 and {r.id: r.chunk for r in out} == want and all(r.wide for r in out)


def test_rules_that_go_by_order(spark):
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, 3, "a"), (1, 4, "b")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 0, "z"), (2, 5, None)], "k int, o int, v string")
    of = lambda rule: {r.k: r[1] for r in setops.merge_rows([a, b], ["k"], {"v": rule}, ["o"]).collect()}
    assert of("first") == {1: "b", 2: None} and of("append") == {1: "b,a,b,z", 2: ""} and of("append-missing") == {1: ".,b,a,b,z", 2: "."} and of("distinct") == {1: "b,a,z", 2: ""}


def test_tags_of_sites_and_genotypes(spark):
    ad = spark.createDataFrame([([6, 3, 1],), ([0, 0],), ([1, None],)], "ad array<int>").select(stats.vaf(F.col("ad")).alias("v"), stats.vaf1(F.col("ad")).alias("w")).collect()
    assert (ad[0].v, round(ad[0].w, 9)) == ([0.3, 0.1], 0.4) and (ad[1].v, ad[1].w) == ([0.0], 0.0) and (ad[2].v, ad[2].w) == (None, None)
    x = spark.createDataFrame([("1", 10, "AC", ["A", "GT"]), ("1", 3, "A", [])], "chrom string, pos long, ref string, alt array<string>")
    assert sorted((r.pos, r.END, r.TYPE) for r in stats.site_tags(x).collect()) == [(3, 3, "REF"), (10, 11, "MNP,INDEL")]
    exons = spark.createDataFrame([("1", 8, 20), ("1", 40, 42)], "chrom string, beg long, end long")
    v = spark.createDataFrame([("1", 10, "A", ["AT", "ATTT"]), ("1", 18, "ACGTT", ["A"]), ("1", 39, "ACGT", ["A"]), ("1", 30, "A", ["AT"])], "chrom string, pos long, ref string, alt array<string>")
    assert {(r.pos, r.allele): r.oof for r in stats.frameshifts(v, exons).collect()} == {(10, "AT"): True, (10, "ATTT"): False, (18, "A"): True, (39, "A"): False}


def test_oxford_and_haplotypes(spark, tmp_path):
    (tmp_path / "x.gen").write_text("1:5_A_G rs 5 A G 1 0 0 0 1 0 0.33 0.33 0.33\n")
    df = tf.read_gen(spark, str(tmp_path / "x.gen"), ["a", "b", "c"])
    r = df.first()
    assert r.chrom == "1" and [s.gt for s in r.samples] == [[0, 0], [0, 1], [None, None]]
    assert tf.gen_lines(df).first().value == "1:5_A_G rs 5 A G 1 0 0 0 1 0 0.33 0.33 0.33"
    assert tf.hap_lines(df).first().value == "1:5_A_G rs 5 A G 0* 0* 0* 1* ? ?"
    blocks = tf.expand_blocks(spark.createDataFrame([("1", 2, 4, "C")], "chrom string, pos long, end long, ref string"), spark.createDataFrame([("1", "ACGT")], "chrom string, seq string"))
    assert sorted((x.pos, x.ref) for x in blocks.collect()) == [(2, "C"), (3, "G"), (4, "T")]


def test_merged_records(spark):
    cols = "chrom string, pos long, id array<string>, ref string, alt array<string>, qual double, filters array<string>, samples array<struct<sample:string,gt:array<int>,phased:boolean,DP:int,AD:array<int>,PL:array<int>>>"
    a = spark.createDataFrame([("1", 5, ["x"], "A", ["G"], 10.0, ["PASS"], [("s", [0, 1], False, 7, [3, 4], [9, 0, 8])]), ("1", 9, [], "A", ["AT"], None, [], [("s", [1, 1], True, 2, [0, 2], [9, 3, 0])])], cols)
    b = spark.createDataFrame([("1", 5, ["y", "x"], "A", ["T", "G"], 30.0, ["low"], [("t", [1, 2], True, 9, [1, 2, 6], [90, 80, 70, 60, 0, 50])]), ("1", 9, [], "AC", ["A"], 5.0, ["PASS"], [("t", [None, 1], False, 1, None, None)]), ("1", 5, [], "A", ["C"], 1.0, ["PASS"], [("t", [0, 1], False, 1, [1, 1], [1, 0, 1])])], cols)
    out = sorted(merge.merge_records([a, b], [["s"], ["t"]], by_allele=("AD",), by_genotype=("PL",), plain=("DP",)).collect(), key=lambda r: (r.pos, len(r.sources), r.alt))
    assert len(out) == 3
    both = next(o for o in out if o.pos == 5 and o.sources == [0, 1])
    alone = next(o for o in out if o.pos == 5 and o.sources == [1])
    # of b's two rows the one with the allele that both sources have is merged first
    assert (both.alt, both.qual, both.filters, both.id) == (["G", "T"], 30.0, ["low"], ["x", "y"]) and (alone.alt, alone.filters) == (["C"], ["PASS"])
    assert [(s.gt, s.DP, s.AD, s.PL) for s in both.samples] == [([0, 1], 7, [3, 4, None], [9, 0, 8, None, None, None]), ([2, 1], 9, [1, 6, 2], [90, 60, 50, 80, 0, 70])]
    assert alone.samples[0].gt == [None, None] and both.samples[1].phased
    indel = next(o for o in out if o.pos == 9)
    assert (indel.ref, indel.alt, indel.qual, indel.filters) == ("AC", ["ATC", "A"], 5.0, ["PASS"])
    assert [(s.sample, s.gt, s.AD, s.PL) for s in indel.samples] == [("s", [1, 1], [0, 2, None], [9, 3, 0, None, None, None]), ("t", [None, 2], None, None)]
    same = merge.merge_records([a, a], [["s"], ["s"]], by_allele=("AD",)).filter("pos = 5").first()
    assert [s.sample for s in same.samples] == ["1:s", "2:s"] and same.qual == 10.0 and same.id == ["x"]
    fill = merge.merge_records([a, b.filter("pos = 9")], [["s"], ["t"]], missing_to_ref=True).filter("pos = 5").first()
    assert fill.samples[1].gt == [0, 0] and fill.samples[1].sample == "t"
    with pytest.raises(ValueError):
        merge.merge_records([a, a], [["s"], ["s"]], prefix_clashes=False)
    local = b.filter("size(alt) = 2").select(merge.local_alleles(F.col("samples"), 1).alias("s")).first().s[0]
    assert local.laa == [0, 1] and local.lpl == [90, 80, 70]


def test_pairs_of_samples_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(p), f"s{s}", int(v)) for p in range(60) for s in range(9) for v in rng.choice([1, 2, 4, 0], 1) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "pos int, sample string, mask int")
    want = {}
    for p, s, v in rows:
        for q, t, w in rows:
            if p == q and s > t:
                n, bad = want.get((s, t), (0, 0))
                want[s, t] = n + 1, bad + (v & w == 0)
    for tile, cells in ((512, 1 << 20), (2, 40)):
        monkeypatch.setattr(genotypes, "TILE", tile)
        monkeypatch.setattr(genotypes, "CELLS", cells)
        got = {(r.q_sample, r.g_sample): (r.n_sites, r.n_mismatches) for r in genotypes.pair_discordance(df, df, ["pos"], "sample", "mask", True).collect()}
        assert got == want
