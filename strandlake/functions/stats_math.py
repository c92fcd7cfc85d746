"""Statistics as columns: array reductions, exact tests, genotype classes, genotype indices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reduce_array(name: str, a: Column) -> Column:
    """One value of an array of numbers without its missing ones; null if nothing is left (COUNT: 0)."""
    x = F.filter(a, lambda v: v.isNotNull())
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    if name == "COUNT":
        return n.cast("double")
    if name == "MAX":
        return F.array_max(x)
    if name == "MIN":
        return F.array_min(x)
    if name == "SUM":
        return F.when(n > 0, total)
    if name in ("AVG", "MEAN"):
        return F.when(n > 0, total / n)
    if name == "MEDIAN":
        s = F.array_sort(x)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    mean = total / n  # population deviation; one value has none
    return F.when(n == 1, 0.0).when(n > 1, F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n))


def log_factorial(n: Column) -> Column:
    """ln n!: a table up to 32, Stirling's series above."""
    x = n.cast("double")
    direct = F.get(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(33))), F.greatest(F.lit(0), F.least(n.cast("int"), F.lit(32))))
    z = x + 1
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return F.when(x < 33, direct).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binom_two_sided(a: Column, b: Column) -> Column:
    """Two-sided binomial test of a against b at one half: twice the lower tail, one at most."""
    n, k = (a + b).cast("int"), F.least(a, b).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.exp(log_choose(n, i) - n * 0.6931471805599453))
    return F.when(a.isNull() | b.isNull(), None).when(n == 0, 1.0).when(a == b, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def fisher_margins(r: Column, s: Column, n: Column) -> Column:
    """What the first row r, the first column s and the sum n of a 2 x 2 table add to ln of its probability."""
    return log_factorial(r) + log_factorial(n - r) + log_factorial(s) + log_factorial(n - s) - log_factorial(n)


def fisher_cells(k: Column, r: Column, s: Column, n: Column) -> Column:
    """What its cells, k the first of them, take away."""
    return log_factorial(k) + log_factorial(r - k) + log_factorial(s - k) + log_factorial(n - r - s + k)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact test of a 2 x 2 table: the probability of all tables no likelier than this one. All within one row: for counts that grow
    with the data use stats.fisher_tests."""
    a, b, c, d = (x.cast("int") for x in (a, b, c, d))
    r, s, n = a + b, a + c, a + b + c + d
    base = fisher_margins(r, s, n)
    lp = lambda k: base - fisher_cells(k, r, s, n)
    own = lp(a)
    lo, hi = F.greatest(F.lit(0), r + s - n), F.least(r, s)
    p = F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda t, k: t + F.when(lp(k) <= own + 1e-7, F.exp(lp(k))).otherwise(0.0))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def hwe_chi2(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    """Chi-square statistic of Hardy-Weinberg proportions."""
    n = (hom_ref + het + hom_alt).cast("double")
    p = (2 * hom_ref + het) / (2 * n)
    e = [n * p * p, 2 * n * p * (1 - p), n * (1 - p) * (1 - p)]
    return sum((F.when(x > 0, (o - x) * (o - x) / x).otherwise(0.0) for o, x in zip((hom_ref, het, hom_alt), e)), F.lit(0.0))


def hwe_exact(n_ref: Column, n_alt: Column, n_het: Column) -> tuple[Column, Column]:
    """(HWE, ExcHet) of allele counts and observed heterozygotes. Under Hardy-Weinberg equilibrium h heterozygotes among the
    genotypes that n_ref and n_alt alleles can form have a probability in proportion to 2^h over the factorials of the three
    genotype counts; h has the parity of the rarer allele. HWE sums what is no likelier than the observed count, ExcHet what
    has as many heterozygotes or more."""
    a, b, seen = n_ref.cast("int"), n_alt.cast("int"), n_het.cast("int")
    rare = F.least(a, b)
    counts = F.sequence(rare % 2, rare, F.lit(2))
    weight = lambda h: h * math.log(2.0) - log_factorial(h) - log_factorial((a - h) / 2) - log_factorial((b - h) / 2)
    logs = F.transform(counts, weight)
    top = F.array_max(logs)
    share = F.transform(logs, lambda x: F.exp(x - top))
    pairs = F.arrays_zip(counts.alias("h"), share.alias("w"))
    total = F.aggregate(share, F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate(F.filter(pairs, lambda p: p["h"] == seen), F.lit(0.0), lambda s, p: s + p["w"])
    rarer = F.aggregate(share, F.lit(0.0), lambda s, x: s + F.when(x <= own * (1 + 1e-9), x).otherwise(0.0))
    above = F.aggregate(F.filter(pairs, lambda p: p["h"] >= seen), F.lit(0.0), lambda s, p: s + p["w"])
    none = (rare <= 0) | a.isNull() | b.isNull()
    return F.when(none, 1.0).otherwise(F.least(F.lit(1.0), rarer / total)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), above / total))


def variant_type(ref: Column, alt: Column) -> Column:
    """Type of one ALT: ref, snp, mnp, indel, bnd, overlap or other."""
    plain = alt.rlike("^[ACGTNacgtn]+$")
    return F.when(alt.isNull(), None).when(alt == "*", "overlap").when(alt.rlike(r"[\[\]]"), "bnd").when(~plain, F.when(alt.isin("<*>", "<NON_REF>"), "ref").otherwise("other")).when(alt == ref, "ref").when(F.length(alt) != F.length(ref), "indel").when(F.length(ref) == 1, "snp").otherwise("mnp")


# Names of genotype classes.
GT_CLASSES = ("ref", "alt", "mis", "hom", "het", "hap", "RR", "AA", "RA", "AR", "Aa", "aA", "R", "A")


def gt_is(gt: Column, name: str) -> Column:
    """Whether a genotype (array of allele indices, null: missing) belongs to a class, or is written so ("0/1")."""
    missing = gt.isNull() | (F.size(gt) == 0) | F.exists(gt, lambda a: a.isNull())
    same = F.size(F.array_distinct(gt)) == 1
    has_ref, ref, diploid = F.array_contains(gt, 0), F.forall(gt, lambda a: a == 0), F.size(gt) > 1
    if name not in GT_CLASSES:
        want = [None if x == "." else int(x) for x in name.replace("|", "/").split("/")]
        return F.coalesce(F.array_sort(gt) == F.array_sort(F.array(*(F.lit(x).cast("int") for x in want))), F.lit(False))
    test = {
        "mis": missing, "ref": ref, "alt": F.exists(gt, lambda a: a > 0), "hom": diploid & same, "het": diploid & ~same, "hap": F.size(gt) == 1,
        "RR": diploid & ref, "AA": diploid & same & ~ref, "RA": diploid & ~same & has_ref, "AR": diploid & ~same & has_ref,
        "Aa": diploid & ~same & ~has_ref, "aA": diploid & ~same & ~has_ref, "R": (F.size(gt) == 1) & ref, "A": (F.size(gt) == 1) & ~ref,
    }[name]
    return F.coalesce(test if name == "mis" else ~missing & test, F.lit(False))


def genotype_index(a: Column, b: Column) -> Column:
    """Place of the unordered genotype of alleles a and b in a vector with one value for each genotype."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.expr("0") + (hi * (hi + 1) / 2).cast("int") + lo
