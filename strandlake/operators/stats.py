"""Summary statistics: histograms with under- and overflow, substitution tables, tag filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import stats_math as M
from strandlake.operators.regions import overlap_join


def bin_of(x: Column, least: float, most: float, step: float) -> Column:
    """Index of a histogram bin: -1 below `least`, the number of bins at `most` or above."""
    n = int(round((most - least) / step))
    return F.when(x < least, -1).when(x >= most, n).otherwise(F.floor((x - least) / step).cast("int"))


def histogram(df: DataFrame, x: Column, least: float, most: float, step: float, *by: str) -> DataFrame:
    """bin, n and share of rows (of each group of `by`)."""
    h = df.groupBy(*by, bin_of(x, least, most, step).alias("bin")).agg(F.count("*").alias("n"))
    if not by:
        total = df.agg(F.count(x)).first()[0]
        return h.filter("bin IS NOT NULL").withColumn("share", F.col("n") / F.lit(float(total or 1)))
    totals = h.groupBy(*by).agg(F.sum("n").alias("_t"))
    return h.join(totals, list(by)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def log_bin(x: Column, digits: int = 2) -> Column:
    """Lower end of a bin of values that agree in their first digits: exact below 10**digits."""
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10(F.greatest(x, F.lit(1)))) - (digits - 1)))
    return (F.floor(x / scale) * scale).cast("long")


TRANSITION_PAIRS = ("A>G", "G>A", "C>T", "T>C")


def substitution(ref: Column, alt: Column) -> Column:
    return F.concat(ref, F.lit(">"), alt)


def ts_tv(df: DataFrame, ref: Column, alt: Column) -> DataFrame:
    """ts, tv and their ratio (0 where there is no transversion)."""
    is_ts = substitution(ref, alt).isin(*TRANSITION_PAIRS)
    g = df.agg(F.count_if(is_ts).alias("ts"), F.count_if(~is_ts & (ref != alt)).alias("tv"))
    return g.withColumn("ratio", F.when(F.col("tv") > 0, F.col("ts") / F.col("tv")).otherwise(0.0))


def fill_tags(long: DataFrame, site: list[str], gt: str = "gt", n_alt: Column | None = None, populations: DataFrame | None = None) -> DataFrame:
    """A row for each site (and population) from long genotypes (sample, gt: array of allele indices, null: missing).
    AN, NS, F_MISSING and MAF (frequency of the second most frequent allele), and for each ALT an entry of AC, AF, AC_Hom, AC_Het,
    AC_Hemi, HWE and ExcHet. n_alt: number of ALTs of a site; populations: rows (sample, population), of which a sample may have
    several; the population null is all samples. Alleles of genotypes that are missing in part count for AN and AC only."""
    keys = [*site, "population"] if populations is not None else site
    x = long.withColumn("_gt", F.coalesce(F.col(gt), F.array().cast("array<int>"))).withColumn("_alts", n_alt if n_alt is not None else F.lit(1))
    if populations is not None:
        x = x.join(populations.groupBy("sample").agg(F.collect_set("population").alias("_in")), "sample", "left")
        x = x.withColumn("population", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("_in", F.array().cast("array<string>")))))
    g = F.col("_gt")
    x = x.withColumn("_missing", (F.size(g) == 0) | F.exists(g, lambda a: a.isNull())).withColumn("_same", F.size(F.array_distinct(g)) == 1)
    # one row for each allele of a genotype, and one (-1) for the genotype itself: what follows is combined on the way
    x = x.withColumn("_k", F.explode(F.concat(F.array(F.lit(-1)), F.filter(F.array_distinct(g), lambda a: a.isNotNull()))))
    whole, n = ~F.col("_missing"), F.size(F.filter("_gt", lambda a: a == F.col("_k")))
    many = whole & (F.size("_gt") > 1)
    per = x.groupBy(*keys, "_k").agg(
        F.max("_alts").alias("alts"), F.count("*").alias("n"), F.count_if(whole).alias("full"),
        F.sum(F.when(many & F.col("_same"), n).otherwise(0)).alias("hom"), F.count_if(many & ~F.col("_same")).alias("het"),
        F.count_if(whole & (F.size("_gt") == 1)).alias("hemi"), F.sum(F.when(many & ~F.col("_same"), n).otherwise(0)).alias("in_het"),
        F.sum(F.when(F.col("_missing"), n).otherwise(0)).alias("part"),
    )
    per = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct("alts", "n", "full", "hom", "het", "hemi", "in_het", "part")))).alias("_m"))
    of = lambda k, f: F.coalesce(F.try_element_at("_m", k)[f], F.lit(0))
    at = lambda f: F.coalesce(F.try_element_at("_m", F.lit(-1))[f], F.lit(0))
    each = F.sequence(F.lit(1), F.greatest(F.lit(1), at("alts").cast("int")))
    count = lambda k: of(k, "hom") + of(k, "in_het") + of(k, "hemi") + of(k, "part")
    entry = lambda f: F.transform(each, f)
    y = per.withColumn("AC", entry(count)).withColumn("_ref", count(F.lit(0)))
    y = y.withColumn("AN", F.col("_ref") + F.aggregate("AC", F.lit(0).cast("long"), lambda t, v: t + v))
    hets = F.aggregate(F.map_keys("_m"), F.lit(0).cast("long"), lambda t, k: t + F.when(k >= 0, of(k, "het")).otherwise(0))
    y = y.withColumn("_hets", hets)
    exact = lambda k: M.hwe_exact(of(F.lit(0), "hom") + F.col("_hets") - of(k, "het"), of(k, "het") + of(k, "hom"), of(k, "het"))
    every = F.sort_array(F.concat(F.array("_ref"), F.col("AC")), asc=False)
    return y.select(
        *keys, "AN", "AC", F.transform("AC", lambda v: F.when(F.col("AN") > 0, v / F.col("AN"))).alias("AF"), entry(lambda k: of(k, "hom")).alias("AC_Hom"), entry(lambda k: of(k, "het")).alias("AC_Het"),
        entry(lambda k: of(k, "hemi")).alias("AC_Hemi"), entry(lambda k: exact(k)[0]).alias("HWE"), entry(lambda k: exact(k)[1]).alias("ExcHet"), at("full").alias("NS"), (1 - at("full") / at("n")).alias("F_MISSING"),
        F.when(F.col("AN") > 0, F.get(every, F.lit(1)) / F.col("AN")).alias("MAF"),
    )


def biallelic(tags: DataFrame) -> DataFrame:
    """fill_tags of sites with one ALT, with plain columns instead of arrays."""
    return tags.withColumns({c: F.get(c, F.lit(0)) for c in ("AC", "AF", "AC_Hom", "AC_Het", "AC_Hemi", "HWE", "ExcHet")})


def site_tags(df: DataFrame) -> DataFrame:
    """Adds END (last position of REF, or what INFO/END says) and TYPE (the types of the ALTs, upper case) to variant rows."""
    order = ("ref", "snp", "mnp", "indel", "other", "bnd", "overlap")
    types = F.array_distinct(F.transform("alt", lambda a: M.variant_type(F.col("ref"), a)))
    named = F.filter(F.array(*map(F.lit, order)), lambda t: F.array_contains(types, t) & ((t != "ref") | (F.size(types) == 1)))
    return df.withColumn("END", F.col("pos") + F.length("ref") - 1).withColumn("TYPE", F.when(F.size("alt") == 0, "REF").otherwise(F.upper(F.array_join(named, ","))))


def vaf(ad: Column) -> Column:
    """Share of reads of each ALT, from depths of all alleles; null if a depth is missing, nought without reads."""
    total = F.aggregate(ad, F.lit(0.0), lambda s, x: s + x)
    return F.when(~F.exists(ad, lambda x: x.isNull()), F.transform(F.slice(ad, 2, 1 << 20), lambda x: F.when(total > 0, x / total).otherwise(0.0)))


def vaf1(ad: Column) -> Column:
    """Share of reads of all ALTs together."""
    return F.aggregate(vaf(ad), F.lit(0.0), lambda s, x: s + x)


# sections of the summary report, over variant rows (chrom, pos, ref, alt)
def _types(df: DataFrame) -> DataFrame:
    return df.withColumn("_types", F.array_distinct(F.transform("alt", lambda a: M.variant_type(F.col("ref"), a))))


def fisher_tests(df: DataFrame, a: str, b: str, c: str, d: str, name: str = "p", block: int = 1 << 14) -> DataFrame:
    """Rows of df, no two of them equal, with the two-sided exact test of the table in four of their columns (M.fisher_exact), for counts of any size: the
    tables with the same margins go to the tasks a block at a time, as rows."""
    r, s, n = F.col(a) + F.col(b), F.col(a) + F.col(c), F.col(a) + F.col(b) + F.col(c) + F.col(d)
    x = df.withColumn("_r", r).withColumn("_s", s).withColumn("_n", n).withColumn("_base", M.fisher_margins(r, s, n))
    r, s, n, base = (F.col(f"_{m}") for m in ("r", "s", "n", "base"))
    lo, hi = F.greatest(F.lit(0), r + s - n).cast("long"), F.least(r, s).cast("long")
    x = x.withColumn("_hi", hi).withColumn("_own", base - M.fisher_cells(F.col(a), r, s, n)).withColumn("_lo", F.explode(F.sequence(lo, hi, F.lit(block).cast("long"))))
    # the number of partitions is given: blocks are small rows, which would be put into one task again
    x = x.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = x.withColumn("_k", F.explode(F.sequence("_lo", F.least(F.col("_lo") + (block - 1), F.col("_hi")))))
    x = x.select(*df.columns, "_own", (base - M.fisher_cells(F.col("_k"), r, s, n)).alias("_lp"))
    p = F.sum(F.when(F.col("_lp") <= F.col("_own") + 1e-7, F.exp("_lp")))
    return x.groupBy(*df.columns).agg(F.least(F.lit(1.0), p).alias(name))


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Records, those without ALT, with SNPs, MNPs, indels and others (a row counts once in each), with several ALTs, and with several
    that are all SNPs; for each group of `by`, such as the set of files that hold a record."""
    has = lambda *t: F.exists("_types", lambda x: x.isin(*t))
    many = F.size("alt") > 1
    return _types(df).groupBy(*by).agg(
        F.count("*").alias("records"), F.count_if(F.forall("_types", lambda t: t == "ref")).alias("no_alts"), F.count_if(has("snp")).alias("snps"), F.count_if(has("mnp")).alias("mnps"),
        F.count_if(has("indel")).alias("indels"), F.count_if(has("other", "bnd", "overlap")).alias("others"), F.count_if(many).alias("multiallelic"),
        F.count_if(many & F.forall("_types", lambda t: t == "snp")).alias("multiallelic_snps"),
    )


def each_alt(df: DataFrame) -> DataFrame:
    """A row for each ALT: allele, alt_index (from 1), type, ilen."""
    x = df.select("*", F.posexplode("alt").alias("_k", "allele")).withColumn("alt_index", F.col("_k") + 1).drop("_k")
    plain = F.col("allele").rlike("^[A-Za-z]+$")
    return x.withColumn("type", M.variant_type(F.col("ref"), F.col("allele"))).withColumn("ilen", F.when(plain, F.length("allele") - F.length("ref")))


def ts_tv_by(df: DataFrame, value: Column, least: float, most: float, n: int) -> DataFrame:
    """Transitions and transversions of first ALTs that are SNPs by bins of a value; what lies outside goes to the end bins."""
    x = df.withColumn("_value", value).withColumn("_alt", F.get("alt", F.lit(0))).filter(M.variant_type(F.col("ref"), F.get("alt", F.lit(0))) == "snp")
    b = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col("_value") - least) / (most - least) * n))).cast("int")
    ts = substitution(F.upper("ref"), F.upper("_alt")).isin(*TRANSITION_PAIRS)
    return x.filter("_value IS NOT NULL").groupBy(b.alias("bin")).agg(F.count("*").alias("snps"), F.count_if(ts).alias("ts"), F.count_if(~ts).alias("tv"))


def af_spectrum(df: DataFrame, ac: str, an: str, bins: int = 100) -> DataFrame:
    """By ALT allele frequency, with singletons (one copy) as bin -1: SNPs, transitions, transversions, indels. ac: array column with a count
    for each ALT, an: called alleles."""
    x = each_alt(df.filter(F.col(an) > 0)).withColumn("_ac", F.get(F.col(ac), F.col("alt_index") - 1)).filter("_ac > 0")
    b = F.when(F.col("_ac") == 1, -1).otherwise(F.least(F.lit(bins - 1), F.floor(F.col("_ac") * bins / F.col(an)))).cast("int")
    ts = substitution(F.upper("ref"), F.upper("allele")).isin(*TRANSITION_PAIRS)
    snp = F.col("type") == "snp"
    return x.groupBy(b.alias("bin")).agg(F.count_if(snp).alias("snps"), F.count_if(snp & ts).alias("ts"), F.count_if(snp & ~ts).alias("tv"), F.count_if(F.col("type") == "indel").alias("indels"))


def indel_lengths(df: DataFrame, most: int = 60) -> DataFrame:
    """Sites by length of their indel ALTs (below 0: deletions); longer ones than `most` count as `most`."""
    x = each_alt(df).filter("type = 'indel' AND ilen IS NOT NULL")
    return x.groupBy(F.greatest(F.lit(-most), F.least(F.lit(most), F.col("ilen"))).alias("length")).agg(F.count("*").alias("sites"))


def het_percentiles(tags: DataFrame, bins: int = 20) -> DataFrame:
    """By bin of allele frequency: sites, and quartiles of the share of heterozygous samples. tags: AF, AC_Het, NS of sites with one ALT."""
    x = tags.filter("NS > 0 AND AF > 0").withColumn("het", F.col("AC_Het") / F.col("NS"))
    q = lambda p: F.percentile("het", F.lit(p))
    return x.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("AF") * bins)).cast("int").alias("bin")).agg(F.count("*").alias("sites"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"))


def vaf_distribution(long: DataFrame, kind: Column, ad: str = "ad", bins: int = 20) -> DataFrame:
    """Genotypes of each sample by kind of variant and bin of the share of ALT reads."""
    v = vaf1(F.col(ad))
    return long.withColumn("kind", kind).withColumn("_v", v).filter("_v IS NOT NULL").groupBy("sample", "kind", F.least(F.lit(bins - 1), F.floor(F.col("_v") * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def allele_lengths(df: DataFrame) -> DataFrame:
    """How many REFs and ALTs have each length."""
    x = df.select(F.explode(F.concat(F.array(F.struct(F.lit("ref").alias("what"), F.length("ref").alias("length"))), F.transform("alt", lambda a: F.struct(F.lit("alt").alias("what"), F.length(a).alias("length"))))).alias("_l"))
    return x.groupBy("_l.length").agg(F.count_if(F.col("_l.what") == "ref").alias("refs"), F.count_if(F.col("_l.what") == "alt").alias("alts"), F.count("*").alias("n"))


def type_counts(df: DataFrame, samples: str | None = None) -> DataFrame:
    """One row: sites, SNPs, indels, MNPs, others (by first type of each kind in a site), and samples."""
    s = summary(df).select(F.col("records").alias("sites"), "snps", "indels", "mnps", "others")
    n = df.agg(F.coalesce(F.max(F.size(samples)), F.lit(0)).alias("samples")) if samples else df.sparkSession.range(1).select(F.lit(0).alias("samples"))
    return s.crossJoin(n)  # one row each


def af_deviation(long: DataFrame, af: Column, bins: int = 20) -> DataFrame:
    """Genotypes by bin of the probability that Hardy-Weinberg proportions at frequency af give them."""
    alts = F.size(F.filter("gt", lambda a: a > 0))
    p = F.when(alts == 0, (1 - af) * (1 - af)).when(alts == 1, 2 * af * (1 - af)).otherwise(af * af)
    x = long.filter((F.size("gt") == 2) & ~F.exists("gt", lambda a: a.isNull())).withColumn("_p", p)
    return x.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("_p") * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def frameshifts(df: DataFrame, exons: DataFrame) -> DataFrame:
    """chrom, pos, ref, allele, oof of each indel ALT that touches an exon: whether it shifts the frame. exons: chrom, beg, end
    (1-based, closed). A deletion that reaches over an exon's edge counts with the part inside."""
    x = each_alt(df).filter("type = 'indel' AND ilen IS NOT NULL").select("chrom", "pos", "ref", "allele", "ilen", (F.col("pos") + 1).alias("_b"), F.when(F.col("ilen") < 0, F.col("pos") - F.col("ilen")).otherwise(F.col("pos") + 1).alias("_e"))
    e = exons.select(F.col("chrom").alias("_chrom"), F.col("beg").alias("_xb"), F.col("end").alias("_xe"))
    met = overlap_join(x, e, [("chrom", "_chrom")], ("_b", "_e"), ("_xb", "_xe"))
    inside = F.when(F.col("ilen") > 0, F.col("ilen")).otherwise(F.least("_e", "_xe") - F.greatest("_b", "_xb") + 1)
    return met.groupBy("chrom", "pos", "ref", "allele").agg(F.max(inside % 3 != 0).alias("oof"))


def distinctive_sites(df: DataFrame, site: str, group: str, value: str) -> DataFrame:
    """pairs: how many pairs of samples (group) a site tells apart, that is, whose values differ; by counting values."""
    c = df.groupBy(site, value).agg(F.count("*").alias("_n"))
    g = c.groupBy(site).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    return g.select(site, ((F.col("_t") * F.col("_t") - F.col("_q")) / 2).cast("long").alias("pairs"))
