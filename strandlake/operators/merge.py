"""Merging of variant rows of several sources into one row a site: alleles, quality, names, filters, genotypes and values that go
with alleles.

Rows of one position and kind (SNPs and MNPs, indels, others; see `kind_of`) become one row; a row without ALT joins the kind that most
sources have there. There is at most one row of each source in a merged one: of several, the one with the allele that most sources have
is merged first and the next ones make further rows, so no row of any source is lost and a group never holds more rows than there
are sources. All windows and groups are within a position, so rows are moved once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.stats_math import genotype_index, variant_type

PAIRINGS = ("both", "snps", "indels", "snp-ins-del", "all", "none", "id")
UNOBSERVED = ("<*>", "<NON_REF>", "<X>")  # ALTs that stand for what was not seen


def kind_of(pairing: str) -> Column:
    """What rows of one position must share; null: no ALT (or only an unobserved one). both: SNPs with SNPs and indels with indels; snps or
    indels: these only, others by equal alleles; snp-ins-del: insertions and deletions apart; all: anything; none: equal alleles; id: equal
    names. Alleles are compared without case."""
    if pairing not in PAIRINGS:
        raise ValueError(f"{pairing} is none of {PAIRINGS}")
    seen = F.filter("alt", lambda a: ~a.isin(*UNOBSERVED))
    types = F.array_distinct(F.transform(seen, lambda a: variant_type(F.upper("ref"), F.upper(a))))
    exact = F.concat_ws(",", F.upper("ref"), F.upper(F.array_join("alt", ",")))
    snp, indel = F.exists(types, lambda t: t.isin("snp", "mnp")), F.exists(types, lambda t: t == "indel")
    plain = F.filter(seen, lambda a: a.rlike("^[A-Za-z]+$"))
    longer, shorter = F.exists(plain, lambda a: F.length(a) > F.length("ref")), F.exists(plain, lambda a: F.length(a) < F.length("ref"))
    kinds = {
        "all": F.lit("*"), "none": exact, "id": F.array_join("id", ";"), "both": F.when(indel, "indel").when(snp, "snp").otherwise("other"),
        "snps": F.when(snp & ~indel, "snp").otherwise(exact), "indels": F.when(indel, "indel").otherwise(exact),
        "snp-ins-del": F.when(indel & longer, "ins").when(indel & shorter, "del").when(snp, "snp").otherwise("other"),
    }
    none = F.size(seen) == 0 if pairing != "id" else F.lit(False)
    return F.when(~none, kinds[pairing])


def merge_records(sources: list[DataFrame], samples: list[list[str]], pairing: str = "both", by_allele: tuple[str, ...] = (), by_genotype: tuple[str, ...] = (), plain: tuple[str, ...] = (), missing_to_ref: bool = False, prefix_clashes: bool = True, missing: dict[str, str | float] | None = None, unobserved: str = "keep") -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filters, samples, sources (in which the site is). sources: variant rows with an array of samples
    (sample, gt, phased, and the fields named), in the order of `samples`: the samples of each source, of which all come in the result.

    REF is the longest there is, and shorter ones' ALTs get its tail; a REF that does not begin like the others is an error. Bases are compared,
    and given, in upper case. ALTs are in order of the sources. qual is the greatest, id and filters are the distinct ones of all (PASS only
    if nothing else). Genotypes go over to the merged alleles; so do fields with a value for each allele, and for each genotype of two
    alleles. Where a source does not know an allele, these take its value for the unobserved allele if it has one, or else go by `missing`: null, a
    number, or "max" (the greatest of the source's values). unobserved: "variants" leaves that allele out where there are others, "all"
    everywhere. Samples of sources without the site have missing genotypes, or reference ones. A sample name that two sources share gets
    the source's number before it, or is an error."""
    names = [n for s in samples for n in s]
    clash = {n for n in names if names.count(n) > 1}
    if clash and not prefix_clashes:
        raise ValueError(f"samples in several sources: {sorted(clash)}")
    told = [[f"{i + 1}:{n}" if n in clash else n for n in s] for i, s in enumerate(samples)]
    cols = ["chrom", "pos", "id", "ref", "alt", "qual", "filters", "samples"]
    both = reduce(DataFrame.unionByName, [s.select(*cols, F.lit(i).alias("_src")) for i, s in enumerate(sources)])
    bases = lambda a: F.when(a.rlike("^[A-Za-z]+$"), F.upper(a)).otherwise(a)
    x = both.withColumn("_kind", kind_of(pairing)).withColumn("ref", F.upper("ref")).withColumn("alt", F.transform("alt", bases)).withColumn("_bare", F.col("_kind").isNull())
    # a row without ALT joins the kind of most sources, SNPs first
    kinds = F.collect_set(F.struct("_kind", "_src")).over(Window.partitionBy("chrom", "pos"))
    x = x.withColumn("_kinds", F.filter(kinds, lambda k: k["_kind"].isNotNull()))
    ranked = F.transform("_kinds", lambda k: F.struct((-F.size(F.filter("_kinds", lambda m: m["_kind"] == k["_kind"]))).alias("n"), F.when(k["_kind"] == "snp", 0).otherwise(1).alias("late"), k["_kind"].alias("kind")))
    x = x.withColumn("_kind", F.coalesce("_kind", F.array_min(ranked)["kind"], F.lit("ref"))).drop("_kinds")
    here = Window.partitionBy("chrom", "pos", "_kind")
    longest = F.max(F.struct(F.length("ref"), "ref")).over(here)["ref"]
    unlike = F.raise_error(F.concat(F.lit("REFs differ at "), "chrom", F.lit(":"), F.col("pos").cast("string"))).cast("string")
    x = x.withColumn("_long", longest).withColumn("_long", F.when(F.col("_long").startswith(F.col("ref")), F.col("_long")).otherwise(unlike))
    tail = F.substring("_long", F.length("ref") + 1, F.length("_long"))
    x = x.withColumn("alt", F.transform("alt", lambda a: F.when(a.rlike("^[A-Z]+$"), F.concat(a, tail)).otherwise(a)))
    # of several rows of a source, the one with the allele that most sources have comes first
    x = x.withColumn("_all", F.flatten(F.collect_list(F.transform("alt", lambda a: F.struct(a.alias("a"), F.col("_src").alias("s")))).over(here)))
    often = F.array_min(F.transform("alt", lambda a: F.struct((-F.size(F.array_distinct(F.filter("_all", lambda m: m["a"] == a)))).alias("n"), a.alias("a"))))
    turn = F.row_number().over(Window.partitionBy("chrom", "pos", "_kind", "_src").orderBy("_bare", "_often", F.array_join("alt", ",")))
    x = x.withColumn("_often", often).withColumn("_turn", turn)
    x = x.groupBy("chrom", "pos", "_kind", "_turn").agg(F.first("_long").alias("ref"), F.array_sort(F.collect_list(F.struct("_src", *cols[2:]))).alias("_r"))
    alts = F.array_distinct(F.flatten(F.col("_r.alt")))
    if unobserved != "keep":
        seen = F.filter(alts, lambda a: ~a.isin(*UNOBSERVED))
        alts = seen if unobserved == "all" else F.when(F.size(seen) > 0, seen).otherwise(alts)
    x = x.withColumn("alt", alts).withColumn("_alleles", F.concat(F.array("ref"), F.col("alt")))
    own = lambda r: F.concat(F.array("ref"), r["alt"])
    # by source: where its alleles are in the merged row, and the other way round
    x = x.withColumn("_to", F.transform("_r", lambda r: F.transform(own(r), lambda a: (F.array_position("_alleles", a) - 1).cast("int"))))
    other = lambda r: F.array_max(F.transform(F.array(*map(F.lit, UNOBSERVED)), lambda u: F.array_position(own(r), u))) - 1
    back = lambda r: F.transform("_alleles", lambda a: F.when(F.array_position(own(r), a) > 0, F.array_position(own(r), a) - 1).otherwise(other(r)).cast("int"))
    x = x.withColumn("_back", F.transform("_r", back))
    n = F.size("_alleles")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.transform(F.sequence(F.lit(0), b), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    x = x.withColumn("_pairs", pairs)
    parts = []
    for i, (was, now) in enumerate(zip(samples, told)):
        if not was:
            continue
        x = x.withColumn(f"_at{i}", F.array_position(F.col("_r._src"), i).cast("int") - 1)
        at = F.col(f"_at{i}")
        x = x.withColumns({f"_row{i}": F.get("_r", at)["samples"], f"_to{i}": F.get("_to", at), f"_back{i}": F.get("_back", at)})
        listed = F.arrays_zip(F.lit(was).alias("was"), F.lit(now).alias("now"))
        parts.append(F.transform(listed, samples_of(i, by_allele, by_genotype, plain, missing_to_ref, missing or {})))
    filters = F.array_distinct(F.flatten(F.col("_r.filters")))
    real = F.array_remove(filters, "PASS")
    return x.select(
        "chrom", "pos", F.array_distinct(F.flatten(F.col("_r.id"))).alias("id"), "ref", "alt", F.array_max(F.col("_r.qual")).alias("qual"),
        F.when(F.size(real) > 0, real).otherwise(filters).alias("filters"), F.concat(*parts).alias("samples"), F.col("_r._src").alias("sources"),
    )


def samples_of(i: int, by_allele, by_genotype, plain, missing_to_ref: bool, missing: dict):
    """Of source i: a name (was, now) and its place to that sample of the merged row. It is looked for where it is not at its place."""
    row, to, back = F.col(f"_row{i}"), F.col(f"_to{i}"), F.col(f"_back{i}")
    none = F.lit(0 if missing_to_ref else None).cast("int")

    def moved(values: Column, rule, picks) -> Column:
        """Values by allele or genotype in the merged row's order; picks: (array to walk, an entry's place in values, or a negative one)."""
        over, place = picks
        unknown = F.array_max(values) if rule == "max" else F.lit(None if rule == "." else rule)
        return F.when(values.isNotNull(), F.transform(over, lambda p: F.when(place(p) >= 0, F.get(values, place(p))).otherwise(unknown)))

    def pair_place(p: Column) -> Column:
        a, b = F.get(back, p["a"]), F.get(back, p["b"])
        return F.when((a >= 0) & (b >= 0), genotype_index(a, b).cast("int")).otherwise(-1)

    def one(name: Column, j: Column) -> Column:
        there = F.get(row, j)
        s = F.when(there["sample"] == name["was"], there).otherwise(F.get(F.filter(row, lambda v: v["sample"] == name["was"]), F.lit(0)))
        gt = F.when(s.isNotNull(), F.transform(s["gt"], lambda g: F.when(g.isNotNull(), F.get(to, g)))).otherwise(F.array(none, none))
        fields = [s[c].alias(c) for c in plain]
        fields += [moved(s[c], missing.get(c), (back, lambda k: k)).alias(c) for c in by_allele]
        fields += [moved(s[c], missing.get(c), (F.col("_pairs"), pair_place)).alias(c) for c in by_genotype]
        return F.struct(name["now"].alias("sample"), gt.alias("gt"), F.coalesce(s["phased"], F.lit(False)).alias("phased"), *fields)

    return one


def local_alleles(samples: Column, most: int, score: str = "PL") -> Column:
    """Samples with laa: REF and the at most `most` ALTs that are in their likeliest genotypes, in order of the alleles, and the
    likelihoods (a value for each genotype of two alleles) of these alone as l<score>."""
    def one(s: Column) -> Column:
        pl = s[score]
        n = F.floor((F.sqrt(8.0 * F.size(pl) + 1) - 1) / 2).cast("int")
        best = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.struct(F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get(pl, genotype_index(j, k).cast("int")))).alias("v"), k.alias("k")))
        kept = F.array_sort(F.transform(F.slice(F.array_sort(best), 1, most), lambda x: x["k"]))
        laa = F.when(pl.isNotNull() & (n > 1), F.concat(F.array(F.lit(0)), kept)).when(pl.isNotNull(), F.array(F.lit(0)))
        m = F.size(laa)
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), m - 1), lambda b: F.transform(F.sequence(F.lit(0), b), lambda a: F.struct(a.alias("a"), b.alias("b")))))
        local = F.when(laa.isNotNull(), F.transform(pairs, lambda p: F.get(pl, genotype_index(F.get(laa, p["a"]), F.get(laa, p["b"])).cast("int"))))
        return s.withField("laa", laa).withField("l" + score.lower(), local)

    return F.transform(samples, one)
