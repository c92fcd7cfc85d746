"""How noisy sites are, from the ALT shares of reads in samples that should not carry the allele (parents). What is kept of a batch of samples is
additive, so batches counted on different days merge to the same scores as one.

Rows are a site (chrom, pos, ref, alt) and a sample with its reads for REF and ALT. Rows without reads, or with null counts, do not count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE = ["chrom", "pos", "ref", "alt"]

# Variances of 20 bins as seen at good sites of some 2000 samples.
KNOWN = [
    1, 1.441327e-03, 4.382657e-05, 6.160600e-07, 1.414270e-08, 2.828540e-09, 2.357117e-09, 2.020386e-09, 1.767838e-09, 1.571411e-09,
    1.414270e-09, 1.285700e-09, 1.178558e-09, 1.087900e-09, 1.010193e-09, 9.428468e-10, 8.839188e-10, 8.319236e-10, 7.857056e-10, 7.443527e-10,
]


def share_bin(n_ref: Column, n_alt: Column, bins: int) -> Column:
    """0 without ALT reads, otherwise the part of the ALT share in bins - 1 parts; null without reads."""
    n = n_ref + n_alt
    return F.when(n > 0, F.floor((bins - 1) * n_alt / n).cast("int"))


def profile(df: DataFrame, n_ref: str = "n_ref", n_alt: str = "n_alt", bins: int = 20) -> DataFrame:
    """The partial form: site, dist (samples by bin of the ALT share) and n (samples with reads). Sites without any keep a row of noughts."""
    if bins < 2:
        raise ValueError("there are two bins at least")
    x = df.withColumn("_bin", share_bin(F.col(n_ref), F.col(n_alt), bins))
    g = x.groupBy(*SITE).agg(*(F.count_if(F.col("_bin") == k).alias(f"_{k}") for k in range(bins)))
    return g.select(*SITE, F.array(*(f"_{k}" for k in range(bins))).alias("dist"), sum(F.col(f"_{k}") for k in range(bins)).alias("n"))


def merged(parts: Sequence[DataFrame], bins: int = 20) -> DataFrame:
    """The partial forms of several batches as one; the numbers of bins must agree."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    same = F.when(F.size("dist") == bins, F.col("dist")).otherwise(F.raise_error(F.lit(f"a profile does not have {bins} bins")).cast("array<bigint>"))
    g = x.withColumn("dist", same).groupBy(*SITE).agg(*(F.sum(F.get("dist", F.lit(k))).alias(f"_{k}") for k in range(bins)), F.sum("n").alias("n"))
    return g.select(*SITE, F.array(*(f"_{k}" for k in range(bins))).alias("dist"), "n")


def _shares(dist: Column) -> Column:
    return F.transform(dist, lambda n: n / F.greatest(F.array_max(dist), F.lit(1)))


def variances(profiles: DataFrame, bins: int = 20) -> list[float]:
    """By bin, how much sites' counts over their largest vary; bins that do not vary get the least of the others, less for bins of
    larger shares. Two sums a bin come to the driver."""
    s = _shares(F.col("dist"))
    x = profiles.filter("n > 0").select(s.alias("s"))
    row = x.agg(F.count("*").alias("n"), *(F.sum(F.get("s", F.lit(k))).alias(f"a{k}") for k in range(bins)), *(F.sum(F.pow(F.get("s", F.lit(k)), 2)).alias(f"q{k}") for k in range(bins))).first()
    if not row["n"]:
        return [1.0] * bins
    # what rounding leaves of bins that do not vary is nought
    var = [v if (v := row[f"q{k}"] / row["n"] - (row[f"a{k}"] / row["n"]) ** 2) > 1e-13 else 0.0 for k in range(bins)]
    least = min([1.0, *(v for v in var if v)])
    return [v or least / (k + 1) for k, v in enumerate(var)]


def spread(variance: Sequence[float], bins: int) -> list[float]:
    """Given variances drawn over another number of bins, on straight lines between them."""
    if len(variance) < 2 or bins < 2:
        raise ValueError("there are two bins at least")
    out = []
    for k in range(bins):
        x = k * (len(variance) - 1) / (bins - 1)
        i = min(int(x), len(variance) - 2)
        out.append(variance[i] + (variance[i + 1] - variance[i]) * (x - i))
    return out


def scores(profiles: DataFrame, variance: Sequence[float] | None = None, bins: int = 20) -> DataFrame:
    """The final form: site, dist, n, score. A site's own score grows with its samples in bins of ALT shares above nought, each measured by how
    little that bin varies (`variance`, by default that of these profiles; KNOWN is another). Where several ALTs share a position, single-base ones are raised by
    three quarters of what they lack to the largest; all others take counts and score of the first of them by (ref, alt)."""
    var = spread(variance, bins) if variance is not None and len(variance) != bins else list(variance) if variance is not None else variances(profiles, bins)
    s = _shares(F.col("dist"))
    own = 10 * F.log(1 + sum(F.pow(F.get(s, F.lit(k)), 2) / var[k] for k in range(1, bins)))
    x = profiles.withColumn("_own", own).withColumn("_long", (F.length("ref") > 1) | (F.length("alt") > 1))
    place = Window.partitionBy("chrom", "pos")
    x = x.withColumn("_top", F.max("_own").over(place))
    x = x.withColumn("_first", F.min(F.when(F.col("_long"), F.struct("ref", "alt", "dist", "n", "_own"))).over(place))
    raised = F.col("_own") + 0.75 * (F.col("_top") - F.col("_own"))
    take = lambda c, mine: F.when(F.col("_long"), F.col(f"_first.{c}")).otherwise(mine)
    return x.select(*SITE, take("dist", F.col("dist")).alias("dist"), take("n", F.col("n")).alias("n"), take("_own", raised).alias("score"))
