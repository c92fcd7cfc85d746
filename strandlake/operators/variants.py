"""Operators on variant rows: chrom, pos, ref, alt (array), qual, filters (array) and samples (array of structs with sample, gt
and other fields). All are column expressions over the arrays; rows never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import stats_math as M
from strandlake.operators.alleles import remap, variant_type


def types_of(df: DataFrame) -> Column:
    return F.transform("alt", lambda a: variant_type(F.col("ref"), a))


def called(samples: Column | str = "samples") -> Column:
    """All alleles that are called, over all samples."""
    s = F.col(samples) if isinstance(samples, str) else samples
    return F.filter(F.flatten(F.transform(s, lambda x: F.coalesce(x["gt"], F.array().cast("array<int>")))), lambda a: a.isNotNull())


def with_counts(df: DataFrame, samples: str = "samples") -> DataFrame:
    """Adds an (called alleles) and ac (array, one count for each ALT)."""
    c = called(samples)
    ac = F.transform(F.sequence(F.lit(0), F.size("alt")), lambda k: F.size(F.filter(c, lambda a: a == k)))
    return df.withColumn("an", F.size(c)).withColumn("ac", F.slice(ac, 2, 1 << 20))


def count_of(kind: str) -> Column:
    """Allele count of a kind, from an and ac: nref, alt1, minor, major or nonmajor."""
    nref = F.aggregate("ac", F.lit(0), lambda s, x: s + x)
    every = F.concat(F.array(F.col("an") - nref), F.col("ac"))
    return {
        "nref": nref, "alt1": F.coalesce(F.get("ac", F.lit(0)), F.lit(0)), "major": F.array_max(every), "nonmajor": F.col("an") - F.array_max(every),
        "minor": F.coalesce(F.get(F.sort_array(every, asc=False), F.lit(1)), F.lit(0)),
    }[kind]


def view(df: DataFrame, min_alleles: int | None = None, max_alleles: int | None = None, known: bool | None = None, types: list[str] | None = None, not_types: list[str] | None = None, filters: list[str] | None = None,
         ac: tuple[int | None, int | None, str] | None = None, af: tuple[float | None, float | None, str] | None = None, genotype: str | None = None, phased: bool | None = None, uncalled: bool | None = None) -> DataFrame:
    """Site selection: cheap conditions first. filters: one of the list must be set ("PASS" and "." as they are written);
    genotype: hom, het or miss in some sample, "^" before it for in none."""
    n = F.size("alt") + 1
    keep = []
    if min_alleles is not None:
        keep.append(n >= min_alleles)
    if max_alleles is not None:
        keep.append(n <= max_alleles)
    if known is not None:
        keep.append((F.size("id") > 0) == F.lit(known))
    if types:
        keep.append(F.exists(types_of(df), lambda t: t.isin(types)))
    if not_types:
        keep.append(~F.exists(types_of(df), lambda t: t.isin(not_types)))
    if filters:
        hit = F.arrays_overlap("filters", F.array(*map(F.lit, filters)))
        keep.append(hit | (F.size("filters") == 0) if "." in filters else hit)
    for k in keep:
        df = df.filter(k)
    if genotype:
        name = {"miss": "mis"}.get(genotype.lstrip("^"), genotype.lstrip("^"))
        some = F.exists("samples", lambda s: M.gt_is(s["gt"], name))
        df = df.filter(~some if genotype[0] == "^" else some)
    if phased is not None:
        every = F.forall("samples", lambda s: F.coalesce(s["phased"], F.lit(False)) | (F.size(s["gt"]) < 2))
        df = df.filter(every if phased else ~every)
    if uncalled is not None:
        none = F.size(called()) == 0
        df = df.filter(none if uncalled else ~none)
    if ac or af:
        df = with_counts(df)
        if ac:
            lo, hi, kind = ac
            df = df.filter(F.coalesce(count_of(kind) >= lo, F.lit(True)) if lo is not None else F.lit(True)).filter(count_of(kind) <= hi if hi is not None else F.lit(True))
        if af:
            lo, hi, kind = af
            x = F.try_divide(count_of(kind).cast("double"), F.col("an"))  # a site without calls has no frequency and goes
            df = df.filter(x >= lo if lo is not None else x.isNotNull()).filter(x <= hi if hi is not None else F.lit(True))
    return df


def subset_samples(df: DataFrame, names: list[str], exclude: bool = False) -> DataFrame:
    """Only these samples, in this order (or all but these)."""
    if exclude:
        return df.withColumn("samples", F.filter("samples", lambda s: ~s["sample"].isin(names)))
    named = lambda n: F.get(F.filter("samples", lambda s: s["sample"] == n), F.lit(0))
    pick = [named(n) for n in names]
    return df.withColumn("samples", F.array_compact(F.array(*pick)))


def private_to(df: DataFrame, names: list[str], private: bool = True) -> DataFrame:
    """Sites whose ALT alleles are seen in these samples only."""
    inside = F.size(F.filter(called(F.filter("samples", lambda s: s["sample"].isin(names))), lambda a: a > 0))
    every = F.size(F.filter(called(), lambda a: a > 0))
    hit = (inside > 0) & (inside == every)
    return df.filter(hit if private else ~hit)


def trim_alts(df: DataFrame, by_alt: tuple[str, ...] = (), unseen_only: bool = True) -> DataFrame:
    """Drops ALTs that no sample has (or only "<*>" ones), with genotypes and arrays of one value an ALT re-indexed."""
    c = F.array_distinct(called())
    keep = F.filter(F.sequence(F.lit(1), F.size("alt")), lambda k: F.array_contains(c, k) if unseen_only else ~F.get("alt", k - 1).isin("<*>", "<NON_REF>"))
    x = df.withColumn("_keep", F.when(F.size("alt") > 0, keep).otherwise(F.array().cast("array<int>")))
    x = x.withColumn("samples", F.transform("samples", lambda s: s.withField("gt", F.transform(s["gt"], lambda a: F.when(a > 0, F.nullif(F.array_position(F.col("_keep"), a), F.lit(0))).otherwise(a).cast("int")))))
    kept = lambda c: F.transform("_keep", lambda k: F.get(c, k - 1))
    for name in ("alt", *by_alt):
        x = x.withColumn(name, kept(F.col(name)))
    return x.drop("_keep")


def soft_filter(df: DataFrame, site: Column, name: str, mode: str = "+") -> DataFrame:
    """Names sites that fail. mode "+" adds to what is set, "x" resets the others to PASS, "" replaces."""
    others = F.array_remove("filters", "PASS")
    added = F.array_distinct(F.concat(others, F.array(F.lit(name)))) if "+" in mode else F.array(F.lit(name))
    ok = F.array(F.lit("PASS")) if "x" in mode else F.when(F.size("filters") == 0, F.array(F.lit("PASS"))).otherwise(F.col("filters"))
    return df.withColumn("filters", F.when(site, ok).otherwise(added))


def set_failed_genotypes(df: DataFrame, mask: Column, to: int | None) -> DataFrame:
    """Genotypes of samples outside the mask become missing (None) or reference (0)."""
    one = lambda s, ok: s.withField("gt", F.when(ok, s["gt"]).otherwise(F.transform(s["gt"], lambda a: F.lit(to).cast("int"))))
    return df.withColumn("samples", F.zip_with("samples", mask, one))


def missing_to_ref(df: DataFrame, phased: bool = False, major: bool = False) -> DataFrame:
    """Missing alleles become the reference, or the major allele."""
    c = called()
    best = F.aggregate(F.sequence(F.lit(0), F.size("alt")), F.struct(F.lit(0).alias("k"), F.lit(-1).alias("n")), lambda s, k: F.when(F.size(F.filter(c, lambda a: a == k)) > s["n"], F.struct(k.alias("k"), F.size(F.filter(c, lambda a: a == k)).alias("n"))).otherwise(s), lambda s: s["k"])
    to = best if major else F.lit(0)
    out = df.withColumn("_to", to)
    fill = lambda s: s.withField("gt", F.transform(s["gt"], lambda a: F.coalesce(a, F.col("_to")))).withField("phased", s["phased"] | (F.lit(phased) & F.exists(s["gt"], lambda a: a.isNull())))
    return out.withColumn("samples", F.transform("samples", fill)).drop("_to")


def fix_ploidy(df: DataFrame, ploidy: Column) -> DataFrame:
    """Genotypes cut, or filled with their last allele, to the ploidy."""
    one = lambda s: s.withField("gt", F.transform(F.sequence(F.lit(0), ploidy - 1), lambda i: F.get(s["gt"], F.least(i, F.size(s["gt"]) - 1))))
    return df.withColumn("samples", F.transform("samples", one))


def pl_to_probs(pl: Column) -> Column:
    """Normalised likelihoods of phred-scaled ones."""
    p = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10))
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda s, v: s + v))


def gl_to_pl(gl: Column) -> Column:
    """Phred-scaled likelihoods, least nought, of log10 ones."""
    return F.transform(gl, lambda x: F.round(-10 * (x - F.array_max(gl))).cast("int"))


def pl_to_gl(pl: Column) -> Column:
    return F.transform(pl, lambda x: -x / 10.0)


def gp_to_gt(gp: Column, n_alleles: Column, threshold: float = 0.0) -> Column:
    """The likeliest diploid genotype if its probability passes the threshold, otherwise missing."""
    best = F.array_position(gp, F.array_max(gp)).cast("int") - 1
    hi = F.floor((F.sqrt(8.0 * best + 1) - 1) / 2).cast("int")
    lo = (best - hi * (hi + 1) / 2).cast("int")
    return F.when(F.array_max(gp) >= threshold, F.array(lo, hi)).otherwise(F.array(F.lit(None).cast("int"), F.lit(None).cast("int")))


def dosage(gt: Column, pl: Column | None = None) -> Column:
    """Expected ALT alleles of a biallelic site: from likelihoods where they are, else from the genotype; missing: -1."""
    hard = F.when(gt.isNull() | F.exists(gt, lambda a: a.isNull()), -1.0).otherwise(F.size(F.filter(gt, lambda a: a > 0)).cast("double"))
    if pl is None:
        return hard
    p = pl_to_probs(pl)
    return F.coalesce(F.when(F.size(pl) == 3, F.get(p, F.lit(1)) + 2 * F.get(p, F.lit(2))), hard)


def impute_info(gp: Column) -> Column:
    """IMPUTE2's information measure from genotype probabilities of all samples of a site."""
    e = F.transform(gp, lambda p: F.get(p, F.lit(1)) + 2 * F.get(p, F.lit(2)))
    f = F.transform(gp, lambda p: F.get(p, F.lit(1)) + 4 * F.get(p, F.lit(2)))
    n = F.size(gp)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    theta = total(e) / (2 * n)
    spread = total(F.zip_with(e, f, lambda x, y: y - x * x))
    return F.when((theta <= 0) | (theta >= 1), 1.0).otherwise(1 - spread / (2 * n * theta * (1 - theta)))


def transfer(df: DataFrame, column: str, source: Column, mode: str = "") -> DataFrame:
    """Column transfer: "" replaces where the source has a value, "+" fills what is missing, "-" replaces what exists, "="
    appends to a list, "." carries missing values too."""
    own = F.col(column) if column in df.columns else F.lit(None)
    new = {
        "": F.coalesce(source, own), "+": F.coalesce(own, source), "-": F.when(own.isNotNull(), F.coalesce(source, own)), ".": source,
        "=": F.array_distinct(F.concat(F.coalesce(own, F.array()), F.coalesce(source, F.array()))) if mode == "=" else None,
    }[mode]
    return df.withColumn(column, new)


def remap_by_alleles(df: DataFrame, values: str, source_alt: str, target_alt: str = "alt") -> DataFrame:
    return df.withColumn(values, remap(F.col(values), F.col(source_alt), F.col(target_alt)))


def match_key(mode: str) -> Column:
    """Pairing key of records at one position. mode: none (exact alleles), snps, indels, both, any, id."""
    t = F.array_sort(F.array_distinct(F.transform("alt", lambda a: variant_type(F.col("ref"), a))))
    exact = F.concat_ws(",", F.upper("ref"), F.array_sort(F.transform("alt", F.upper)))
    of = F.array_join(t, ",")
    return {
        "none": exact, "any": F.lit("*"), "id": F.array_join("id", ";"),
        "snps": F.when(F.array_contains(t, "snp"), "snp").otherwise(exact), "indels": F.when(F.array_contains(t, "indel"), "indel").otherwise(exact),
        "both": F.when(F.array_contains(t, "snp"), "snp").when(F.array_contains(t, "indel"), "indel").otherwise(of),
    }[mode]


def ploidy_of(df: DataFrame, ploidy: DataFrame, default: int = 2) -> DataFrame:
    """Adds ploidy for (chrom, pos, sex) from rows (chrom, beg, end, sex, ploidy), first match by beginning; where no row covers
    a site, the rows with chrom "*" give a sex's default. The map is small and Spark decides how to join it."""
    regions, rest = ploidy.filter("chrom <> '*'"), ploidy.filter("chrom = '*'").select("sex", F.col("ploidy").alias("_d"))
    r = regions.select(F.col("chrom").alias("_c"), "beg", "end", F.col("sex").alias("_s"), F.col("ploidy").alias("_p"))
    keys = df.select("chrom", "pos", "sex").distinct()
    hit = keys.join(r, (F.col("chrom") == F.col("_c")) & (F.col("sex") == F.col("_s")) & F.col("pos").between(F.col("beg"), F.col("end"))).groupBy("chrom", "pos", "sex").agg(F.min_by("_p", "beg").alias("_p"))
    return df.join(hit, ["chrom", "pos", "sex"], "left").join(rest, "sex", "left").withColumn("ploidy", F.coalesce("_p", "_d", F.lit(default))).drop("_p", "_d")
