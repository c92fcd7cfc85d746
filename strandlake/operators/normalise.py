"""Operators that hold variant rows against the reference text: left alignment, REF checks, strand repair; and the editing of
allele lists. The reference is joined as tiles by (chrom, tile), so no row carries a contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.stats_math import genotype_index
from strandlake.operators.alleles import trim_left_align
from strandlake.session import scratch_path
from strandlake.sources.text_formats import tiles

WIDTH = 1 << 12  # bases of a tile


def reference_text(df: DataFrame, fasta: DataFrame, beg: Column, length: Column, name: str = "reference") -> DataFrame:
    """Adds the reference from position beg on, of any length, as far as the contig goes; null where the contig is not known. Texts of up to
    WIDTH bases come from the tile where they begin and the next one; of longer ones each tile that they touch gives its slice, and the slices
    are put together by place before they are joined to the rows."""
    t = tiles(fasta, WIDTH)
    side = lambda k: t.select(F.col("chrom").alias(f"_c{k}"), (F.col("tile") - k).alias(f"_t{k}"), F.col("seq").alias(f"_s{k}"))
    x = df.withColumn("_beg", F.greatest(F.lit(1), beg).cast("long")).withColumn("_len", F.coalesce(length, F.lit(0)).cast("int"))
    y = x.filter(F.col("_len") <= WIDTH).withColumn("_tile", F.floor((F.col("_beg") - 1) / WIDTH))
    for k in (0, 1):
        y = y.join(side(k), (F.col("chrom") == F.col(f"_c{k}")) & (F.col("_tile") == F.col(f"_t{k}")), "left")
    at = (F.col("_beg") - F.col("_tile") * WIDTH).cast("int")
    over = at + F.col("_len") - 1 - WIDTH  # bases in the next tile
    text = F.concat(F.substring("_s0", at, F.col("_len")), F.when(over > 0, F.substring(F.coalesce("_s1", F.lit("")), F.lit(1), over)).otherwise(""))
    short = y.withColumn(name, F.nullif(text, F.lit(""))).select(*df.columns, name)
    wide = x.filter(F.col("_len") > WIDTH)
    where = wide.select(F.col("chrom").alias("_c"), F.col("_beg").alias("_b"), F.col("_len").alias("_l")).distinct()
    each = where.withColumn("_tile", F.explode(F.sequence(F.floor((F.col("_b") - 1) / WIDTH), F.floor((F.col("_b") + F.col("_l") - 2) / WIDTH))))
    each = each.join(t, (F.col("_c") == F.col("chrom")) & (F.col("_tile") == F.col("tile")))
    first = F.greatest(F.col("_b"), F.col("beg"))
    slice_ = F.substring("seq", (first - F.col("beg") + 1).cast("int"), (F.col("_b") + F.col("_l") - first).cast("int"))
    whole = each.groupBy("_c", "_b", "_l").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", slice_.alias("s")))), lambda p: p["s"]), "").alias(name))
    long = wide.join(whole, (F.col("chrom") == F.col("_c")) & (F.col("_beg") == F.col("_b")) & (F.col("_len") == F.col("_l")), "left")
    return short.unionByName(long.select(*df.columns, name))


def left_align(df: DataFrame, fasta: DataFrame, window: int = 1000) -> DataFrame:
    """Rows with pos, ref and alt in leftmost form. Alleles move along the reference up to `window` bases at a time; those that
    have come to the window's edge go on in another round. Symbolic alleles stay as they are."""
    cols, schema, done = df.columns, df.schema, None
    while True:
        first = F.greatest(F.lit(1), F.col("pos") - window)
        x = reference_text(df.withColumn("_first", first), fasta, F.col("_first"), F.col("pos") - F.col("_first") + F.length("ref"), "_seq")

        def run(batches):
            for pdf in batches:
                now = [trim_left_align(p, [r, *a], s, f) if s else (p, [r, *a]) for p, r, a, s, f in zip(pdf["pos"], pdf["ref"], pdf["alt"], pdf["_seq"], pdf["_first"])]
                pdf["_again"] = [p == f and 1 < f < q for (p, _), f, q in zip(now, pdf["_first"], pdf["pos"])]
                pdf["pos"], pdf["ref"], pdf["alt"] = [n[0] for n in now], [n[1][0] for n in now], [n[1][1:] for n in now]
                yield pdf[[*cols, "_again"]]

        x = x.select(*cols, "_first", "_seq").mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _again boolean")
        path = scratch_path(df.sparkSession, "left-align")
        x.write.parquet(path)
        x = df.sparkSession.read.schema(x.schema).parquet(path)
        here = x.filter("NOT _again").select(*cols)
        done = here if done is None else done.unionByName(here)
        df = x.filter("_again").select(*cols)
        if df.isEmpty():
            return done


def check_ref(df: DataFrame, fasta: DataFrame, mode: str = "w") -> DataFrame:
    """REF against the reference. mode w: adds ref_ok; x: drops rows that differ; e: such a row is an error; s: REF is set to the
    reference, and where an ALT is what the reference has, the two change places and genotypes follow. Codes for several bases
    in REF count as N, which agrees with everything. Rows of unknown contigs are left alone (ref_ok null)."""
    plain = F.regexp_replace(F.upper("ref"), "[^ACGTN]", "N")
    x = reference_text(df.withColumn("_plain", plain), fasta, F.col("pos"), F.length("ref"), "_seq")
    bases = F.zip_with(F.split("_plain", ""), F.split("_seq", ""), lambda a, b: F.coalesce(a.isin("N", "") | (a == b) | (b == "N"), F.lit(False)))
    x = x.withColumn("ref_ok", F.when(F.col("_seq").isNotNull(), (F.col("_plain") == F.col("_seq")) | (F.length("_plain") <= F.length("_seq")) & F.forall(F.slice(bases, F.lit(1), F.length("_plain")), lambda b: b)))
    if mode == "w":
        return x.drop("_plain", "_seq")
    if mode == "x":
        return x.filter("coalesce(ref_ok, true)").drop("_plain", "_seq", "ref_ok")
    if mode == "e":
        stop = F.raise_error(F.concat(F.lit("REF differs at "), "chrom", F.lit(":"), F.col("pos").cast("string"))).cast("string")
        return x.withColumn("ref", F.when(F.coalesce("ref_ok", F.lit(True)), F.col("ref")).otherwise(stop)).drop("_plain", "_seq", "ref_ok")
    bad = ~F.coalesce("ref_ok", F.lit(True))
    place = F.coalesce(F.array_position(F.transform("alt", F.upper), F.col("_seq")), F.lit(0)).cast("int")
    x = x.withColumn("_swap", F.when(bad, place).otherwise(0)).withColumn("_old", F.col("ref"))
    x = x.withColumn("ref", F.when(bad, F.col("_seq")).otherwise(F.col("ref")))
    x = x.withColumn("alt", F.transform("alt", lambda a, i: F.when(i + 1 == F.col("_swap"), F.col("_old")).otherwise(a)))
    if "samples" in df.columns:
        turn = lambda g: F.when((F.col("_swap") > 0) & (g == 0), F.col("_swap")).when((F.col("_swap") > 0) & (g == F.col("_swap")), 0).otherwise(g).cast("int")
        x = x.withColumn("samples", F.transform("samples", lambda s: s.withField("gt", F.transform(s["gt"], turn))))
    return x.drop("_plain", "_seq", "ref_ok", "_swap", "_old")


def complement(c: Column) -> Column:
    return F.translate(c, "ACGTacgt", "TGCAtgca")


def fix_ref(df: DataFrame, fasta: DataFrame, mode: str = "flip") -> DataFrame:
    """Strand and order of biallelic SNPs by the reference base; adds fixref (what was done) and the genotypes follow a swap.
    mode flip: pairs other than A/T and C/G are swapped, flipped or both, until REF is the reference's; those two are left
    (skip). flip-all: they too. swap: REF and ALT change places only. top: Illumina's TOP alleles (A with C or G as they
    are; their complements C and G with T flipped) are put into the reference's order. stats: nothing is changed."""
    x = reference_text(df, fasta, F.col("pos"), F.lit(1), "_base")
    a, b = F.upper("ref"), F.upper(F.get("alt", F.lit(0)))
    snp = (F.size("alt") == 1) & a.isin(*"ACGT") & b.isin(*"ACGT") & (a != b) & F.col("_base").isin(*"ACGT")
    pair = F.array_join(F.array_sort(F.array(a, b)), "")
    base, ca, cb = F.col("_base"), complement(a), complement(b)
    same, swap, flip, both = a == base, b == base, ca == base, cb == base
    what = F.when(~snp, "none").when(same, "ok").when(swap, "swap").when(flip, "flip").when(both, "flip+swap").otherwise("unresolved")
    if mode == "flip":
        what = F.when(snp & pair.isin("AT", "CG"), F.when(same, "ok").otherwise("skip")).otherwise(what)
    elif mode == "swap":
        what = F.when(what.isin("flip", "flip+swap"), "unresolved").otherwise(what)
    elif mode == "top":
        what = F.when(snp & pair.isin("AT", "CG"), F.when(same, "ok").when(swap, "swap").otherwise("unresolved")).otherwise(what)
    if mode == "stats":
        return x.withColumn("fixref", what).drop("_base")
    x = x.withColumn("fixref", what)
    f = F.col("fixref")
    flipped = lambda c: F.when(F.contains(f, F.lit("flip")), complement(c)).otherwise(c)
    turned = F.contains(f, F.lit("swap"))
    first, second = flipped(a), flipped(b)
    x = x.withColumn("_ref", F.when(f.isin("none", "ok", "skip", "unresolved"), F.col("ref")).otherwise(F.when(turned, second).otherwise(first)))
    x = x.withColumn("alt", F.when(f.isin("none", "ok", "skip", "unresolved"), F.col("alt")).otherwise(F.array(F.when(turned, first).otherwise(second)))).withColumn("ref", F.col("_ref"))
    if "samples" in df.columns:
        x = x.withColumn("samples", F.transform("samples", lambda s: s.withField("gt", F.transform(s["gt"], lambda g: F.when(turned & (g <= 1), 1 - g).otherwise(g).cast("int")))))
    return x.drop("_base", "_ref")


def fill_from_fasta(df: DataFrame, fasta: DataFrame, column: str = "ref", where: Column | None = None, codes_to_n: bool = False) -> DataFrame:
    """A column from the reference at the record's place, as long as its REF."""
    x = reference_text(df, fasta, F.col("pos"), F.length("ref"), "_new")
    new = F.regexp_replace(F.upper("_new"), "[^ACGTN]", "N") if codes_to_n else F.col("_new")
    own = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return x.withColumn(column, F.when((where if where is not None else F.lit(True)) & new.isNotNull(), new).otherwise(own)).drop("_new")


def old_record(df: DataFrame, name: str = "old_rec") -> DataFrame:
    """Adds where a record comes from, before it is changed: contig, position, REF, ALTs, and the ALT's place if it is one of several."""
    base = F.concat_ws("|", "chrom", F.col("pos").cast("string"), "ref", F.array_join("alt", ","))
    return df.withColumn(name, F.concat_ws("|", base, F.col("alt_index").cast("string")) if "alt_index" in df.columns else base)


def merge_equal_alts(df: DataFrame) -> DataFrame:
    """ALTs that occur twice become one, and genotypes follow."""
    x = df.withColumn("_kept", F.array_distinct(F.transform("alt", F.upper)))
    place = F.transform("alt", lambda a: F.array_position("_kept", F.upper(a)).cast("int"))
    x = x.withColumn("_place", place)
    if "samples" in df.columns:
        x = x.withColumn("samples", F.transform("samples", lambda s: s.withField("gt", F.transform(s["gt"], lambda g: F.when(g > 0, F.get("_place", g - 1)).otherwise(g).cast("int")))))
    first = F.transform("_kept", lambda k: F.get("alt", (F.array_position(F.transform("alt", F.upper), k) - 1).cast("int")))
    return x.withColumn("alt", first).drop("_kept", "_place")


def split_genotype_values(values: Column, k: Column) -> Column:
    """Of an array with a value for each diploid genotype, those of the genotypes of REF and ALT k."""
    at = lambda a, b: F.get(values, genotype_index(a, b).cast("int"))
    return F.array(at(F.lit(0), F.lit(0)), at(F.lit(0), k), at(k, k))


def only_where(df: DataFrame, condition: Column, f) -> DataFrame:
    """f of the rows that fulfil a condition; the others pass as they are."""
    hit = F.coalesce(condition, F.lit(False))
    return f(df.filter(hit)).select(*df.columns).unionByName(df.filter(~hit))
