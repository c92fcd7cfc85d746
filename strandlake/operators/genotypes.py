"""Genotype operators on long tables (site, sample, gt) and on trios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """One row per site and sample."""
    return df.select(*keys, F.posexplode(samples).alias("sample_index", "_s")).select(*keys, "sample_index", "_s.*")


def pair_discordance(q: DataFrame, g: DataFrame, site: list[str], sample: str, value: str, self_join: bool = False) -> DataFrame:
    """q_sample, g_sample, n_sites, n_matches, n_mismatches over shared sites, by dosage bit masks: no common bit, a mismatch.

    Sites are dealt into blocks and samples into tiles; two tiles of a block meet in one task, where counts of all their pairs are
    products of incidence matrices. What leaves a task is a row for each pair of samples, not for each pair and site, and
    blocks are so many that a tile has about CELLS genotypes."""
    a = q.select(F.struct(*site).alias("_site"), F.col(sample).alias("q_sample"), F.col(value).cast("int").alias("_a")).filter("_a IS NOT NULL")
    b = g.select(F.struct(*site).alias("_site2"), F.col(sample).alias("g_sample"), F.col(value).cast("int").alias("_b")).filter("_b IS NOT NULL")
    tiles = [max(1, -(-x.select(c).distinct().count() // TILE)) for x, c in ((a, "q_sample"), (b, "g_sample"))]
    blocks = max(1, max(a.count() // (CELLS * tiles[0]), b.count() // (CELLS * tiles[1])))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = a.withColumn("block", deal("_site", blocks)).withColumn("t1", deal("q_sample", tiles[0])).withColumn("t2", each(tiles[1]))
    b = b.withColumn("block2", deal("_site2", blocks)).withColumn("u2", deal("g_sample", tiles[1])).withColumn("u1", each(tiles[0]))
    a, b = a.withColumn("_site", F.to_json("_site")), b.withColumn("_site2", F.to_json("_site2"))
    kinds = a.schema["q_sample"].dataType.simpleString(), b.schema["g_sample"].dataType.simpleString()
    met = a.groupBy("block", "t1", "t2").cogroup(b.groupBy("block2", "u1", "u2"))
    part = met.applyInPandas(lambda x, y: counts_of_pairs(x, y, self_join), f"q_sample {kinds[0]}, g_sample {kinds[1]}, n bigint, bad bigint")
    return part.groupBy("q_sample", "g_sample").agg(F.sum("n").alias("n_sites"), (F.sum("n") - F.sum("bad")).alias("n_matches"), F.sum("bad").alias("n_mismatches"))


TILE, CELLS, SITES = 512, 1 << 20, 4096  # samples of a tile; genotypes of a tile in a block; sites of a product


def counts_of_pairs(x: pd.DataFrame, y: pd.DataFrame, self_join: bool) -> pd.DataFrame:
    """Shared sites and mismatches of all pairs of samples of two tiles."""
    out = pd.DataFrame({"q_sample": x["q_sample"].iloc[:0], "g_sample": y["g_sample"].iloc[:0], "n": pd.Series(dtype="int64"), "bad": pd.Series(dtype="int64")})
    shared = np.intersect1d(x["_site"].unique().astype(str), y["_site2"].unique().astype(str))
    x, y = x[x["_site"].isin(shared)], y[y["_site2"].isin(shared)]
    if not len(x) or not len(y):
        return out
    qs, gs = (pd.Index(v.unique()) for v in (x["q_sample"], y["g_sample"]))
    n, bad = np.zeros((len(qs), len(gs))), np.zeros((len(qs), len(gs)))
    at = pd.Index(shared)
    for lo in range(0, len(at), SITES):
        cut = at[lo : lo + SITES]
        xs, ys = x[x["_site"].isin(cut)], y[y["_site2"].isin(cut)]
        mats = []
        for df, site, names, sample, value in ((xs, "_site", qs, "q_sample", "_a"), (ys, "_site2", gs, "g_sample", "_b")):
            m = {}
            for v, part in df.groupby(value):
                m[int(v)] = np.zeros((len(names), len(cut)), np.float32)
                np.add.at(m[int(v)], (names.get_indexer(part[sample]), cut.get_indexer(part[site])), 1)
            mats.append(m)
        n += sum(mats[0].values()) @ sum(mats[1].values()).T
        for v, m in mats[0].items():
            other = [w for k, w in mats[1].items() if not v & k]
            if other:
                bad += m @ sum(other).T
    i, j = np.nonzero(n)
    out = pd.DataFrame({"q_sample": qs[i], "g_sample": gs[j], "n": n[i, j].astype(np.int64), "bad": bad[i, j].astype(np.int64)})
    return out[out["q_sample"] > out["g_sample"]] if self_join else out


def concordance(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Table of values of two sources at shared keys."""
    met = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    return met.groupBy("a", "b").agg(F.count("*").alias("n"))


def non_reference_discordance(table: DataFrame, ref: object = 0) -> DataFrame:
    """nrd: 100 * mismatches over all but pairs that are reference on both sides; from a concordance table."""
    other = ~((F.col("a") == ref) & (F.col("b") == ref))
    bad = F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0))
    return table.agg(bad.alias("mismatches"), F.sum(F.when(other, F.col("n")).otherwise(0)).alias("compared")).withColumn("nrd", F.when(F.col("compared") > 0, 100.0 * F.col("mismatches") / F.col("compared")))


def mendelian(kid: Column, father: Column, mother: Column) -> Column:
    """good, error or missing for genotype arrays (null: missing allele): one allele of each parent. A missing parent passes if
    the other one shares an allele."""
    has = lambda g: g.isNotNull() & ~F.exists(g, lambda a: a.isNull())
    k0, k1 = F.get(kid, F.lit(0)), F.get(kid, F.lit(1))
    both = (F.array_contains(father, k0) & F.array_contains(mother, k1)) | (F.array_contains(father, k1) & F.array_contains(mother, k0))
    one = lambda p: F.array_contains(p, k0) | F.array_contains(p, k1)
    return (
        F.when(~has(kid) | (F.size(kid) < 2), "missing")
        .when(~has(father) & ~has(mother), "missing")
        .when(~has(father), F.when(one(mother), "missing").otherwise("error"))
        .when(~has(mother), F.when(one(father), "missing").otherwise("error"))
        .when(both, "good")
        .otherwise("error")
    )


def set_gt(samples: Column, mask: Column, new: str) -> Column:
    """Samples with the genotypes of those in the mask set to "./." (missing), "0" (reference), "p" (phased) or "u" (unphased,
    sorted)."""

    def one(s: Column, hit: Column) -> Column:
        gt = {"./.": F.transform(s["gt"], lambda a: F.lit(None).cast("int")), "0": F.transform(s["gt"], lambda a: F.lit(0)), "p": s["gt"], "u": F.array_sort(s["gt"])}[new]
        out = s.withField("gt", F.when(hit, gt).otherwise(s["gt"]))
        return out.withField("phased", F.when(hit, F.lit(new == "p")).otherwise(s["phased"])) if new in "pu" else out

    return F.zip_with(samples, mask, one)


def dosage_mask(gt: Column) -> Column:
    """1, 2 or 4 for none, one or two ALT alleles; 0 where a genotype is missing."""
    n = F.size(F.filter(gt, lambda a: a > 0))
    return F.when(gt.isNull() | F.exists(gt, lambda a: a.isNull()), 0).otherwise(F.expr("1") * F.pow(F.lit(2), n).cast("int"))


def ld(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n and r2 of two dosage columns by group; NaN where one of them does not vary, null where no row has both."""
    there = F.when(F.col(x).isNotNull(), F.col(y))
    # corr stops with a division by zero where a column does not vary; regr_r2 is null for x, and 1 for y
    r2 = F.when(F.min(there) == F.max(there), float("nan")).when(F.min(there).isNotNull(), F.coalesce(F.regr_r2(y, x), F.lit(float("nan"))))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), r2.alias("r2"))
