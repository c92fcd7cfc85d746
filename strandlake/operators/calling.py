"""Pileups and calls: reads to bases by position, genotype likelihoods, the multiallelic caller, de-novo scores, consensus.

Likelihood work is numpy over Arrow batches, one site at a time; sites are independent."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.normalise import reference_text

CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
PHRED_TO_LN = -0.23025850929940458
LN_TO_PHRED = -4.3429448190325175


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """name, flag, chrom, pos, mapq, cigar, seq, qual (string), rg of SAM text."""
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    return spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(at(0).alias("name"), at(1).cast("int").alias("flag"), at(2).alias("chrom"), at(3).cast("long").alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), at(10).alias("qual"), F.nullif(F.regexp_extract("value", r"\tRG:Z:(\S+)", 1), F.lit("")).alias("rg"))


def aligned(pos: int, cigar: str, seq: str, qual: str) -> list[tuple[int, str, int]]:
    """(position, base, quality) of aligned bases; '*' at deleted positions."""
    out, r, q = [], pos, 0
    for n, op in CIGAR.findall(cigar):
        n = int(n)
        if op in "M=X":
            out += [(r + i, seq[q + i], ord(qual[q + i]) - 33) for i in range(n)]
            r, q = r + n, q + n
        elif op in "DN":
            out += [(r + i, "*", 0) for i in range(n)] if op == "D" else []
            r += n
        elif op in "IS":
            q += n
    return out


def pileup(reads: DataFrame, min_mapq: int = 0, min_baseq: int = 1, skip_flags: int = 0x704, max_depth: int | None = None) -> DataFrame:
    """chrom, pos, sample, base, qual, reverse: one row per read and position. Depth is capped (by name order) only on request."""
    ok = (F.col("flag").bitwiseAND(skip_flags) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "*")

    def run(batches):
        for pdf in batches:
            rows = [(c, p, s, n, b, q, f & 16 > 0) for c, pos, s, n, f, cg, sq, ql in zip(pdf["chrom"], pdf["pos"], pdf["sample"], pdf["name"], pdf["flag"], pdf["cigar"], pdf["seq"], pdf["qual"]) for p, b, q in aligned(pos, cg, sq, ql)]
            yield pd.DataFrame(rows, columns=["chrom", "pos", "sample", "name", "base", "qual", "reverse"])

    out = reads.filter(ok).withColumn("sample", F.coalesce("rg", F.lit("sample"))).select("chrom", "pos", "sample", "name", "flag", "cigar", "seq", "qual").mapInPandas(run, "chrom string, pos long, sample string, name string, base string, qual int, reverse boolean")
    out = out.filter((F.col("base") != "*") & (F.col("qual") >= min_baseq))
    if max_depth is not None:
        from strandlake.operators.setops import top_n

        out = top_n(out, ["chrom", "pos", "sample"], max_depth, F.col("name")).drop("rank")
    return out


def allele_depths(piled: DataFrame, fasta: DataFrame) -> DataFrame:
    """chrom, pos, sample, ref, base, depth, depth_fwd, qual_sum; aggregation is map-side combined, so depth is no burden."""
    g = piled.groupBy("chrom", "pos", "sample", "base").agg(F.count("*").alias("depth"), F.count_if(~F.col("reverse")).alias("depth_fwd"), F.sum("qual").alias("qual_sum"))
    return reference_text(g, fasta, F.col("pos"), F.lit(1), "ref").filter("ref IS NOT NULL")


def genotype_likelihoods(bases: list[str], quals: list[int], alleles: list[str]) -> np.ndarray:
    """Phred-scaled diploid likelihoods (least 0) in genotype order, from independent errors."""
    n = len(alleles)
    e = np.clip(10.0 ** (-np.asarray(quals, float) / 10), 1e-6, 0.75)
    p = np.array([np.where(np.array(bases) == a, 1 - e, e / 3) for a in alleles])
    ll = np.array([np.log((p[a] + p[b]) / 2).sum() for b in range(n) for a in range(b + 1)])
    return np.minimum(255, np.round((ll - ll.max()) * LN_TO_PHRED)).astype(int)


def multiallelic_call(pl: np.ndarray, qs: np.ndarray, theta: float = 1.1e-3, ploidy: int = 2) -> dict:
    """Best subset of up to three alleles for samples x genotypes phred likelihoods and allele frequencies qs (REF first).

    alleles: indices in use; gt: allele pairs of samples (-1: missing); gq; qual."""
    n_all = len(qs)
    q = np.asarray(qs, float)
    q = q / q.sum() if q.sum() else np.full(n_all, 1 / n_all)
    index = {(a, b): b * (b + 1) // 2 + a for b in range(n_all) for a in range(b + 1)}
    p = np.exp(np.asarray(pl, float) * PHRED_TO_LN)
    p = p / p.sum(1, keepdims=True)
    blank = (np.asarray(pl) == 0).all(1)

    def likelihood(subset: tuple[int, ...]) -> float:
        f = q[list(subset)]
        f = f / f.sum() if f.sum() else np.full(len(subset), 1 / len(subset))
        w = {(min(a, b), max(a, b)): 0.0 for a in subset for b in subset}
        for (i, a), (j, b) in itertools.product(enumerate(subset), repeat=2):
            w[min(a, b), max(a, b)] += f[i] * f[j]
        s = sum(p[:, index[g]] * v for g, v in w.items())
        return float(np.log(np.maximum(s[~blank], 1e-300)).sum())

    lk = {}
    for k in (1, 2, 3):
        for sub in itertools.combinations(range(n_all), min(k, n_all)):
            if len(sub) == k and (k == 1 or all(q[a] > 0 for a in sub if a)):
                lk[sub] = likelihood(sub) + sum(np.log(theta) for a in sub if a)
    best = max(lk, key=lambda s: (lk[s], -len(s)))
    use = tuple(sorted({0, *best}))
    ref = lk[(0,)]
    rest = np.logaddexp.reduce([v for s, v in lk.items() if s != (0,)]) if len(lk) > 1 else -np.inf
    whole = np.logaddexp(ref, rest)
    variant = use != (0,)
    qual = max(0.0, LN_TO_PHRED * (ref - whole)) if variant else max(0.0, LN_TO_PHRED * (rest - whole))
    f = np.where(np.isin(np.arange(n_all), use), q, 0)
    gts, gqs = [], []
    for i in range(len(p)):
        if blank[i]:
            gts.append((-1, -1))
            gqs.append(0)
            continue
        pairs = [(a, b) for b in use for a in use if a <= b] if ploidy == 2 else [(a, a) for a in use]
        post = np.array([p[i, index[a, b]] * ((f[a] if ploidy == 1 else f[a] * f[a]) if a == b else 2 * f[a] * f[b]) for a, b in pairs])
        k, s = int(post.argmax()), post.sum()
        gts.append(pairs[k])
        gqs.append(int(min(127, LN_TO_PHRED * np.log(max(1e-30, 1 - post[k] / s)))) if s > 0 else 0)
    return {"alleles": list(use), "gt": gts, "gq": gqs, "qual": float(min(qual, 999.0))}


def call_sites(df: DataFrame, pl: str = "pl", qs: str = "qs", keys: tuple[str, ...] = ("chrom", "pos"), theta: float = 1.1e-3) -> DataFrame:
    """keys, alleles, gt (array of pairs), gq, qual for rows with pl (samples x genotypes) and qs (alleles)."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            found = [multiallelic_call(np.array([list(x) for x in a]), np.array(b), theta) for a, b in zip(pdf[pl], pdf[qs])]
            yield pdf[list(keys)].assign(alleles=[f["alleles"] for f in found], gt=[[list(map(int, g)) for g in f["gt"]] for f in found], gq=[f["gq"] for f in found], qual=[f["qual"] for f in found])

    return df.select(*keys, pl, qs).mapInPandas(run, f"{kinds}, alleles array<int>, gt array<array<int>>, gq array<int>, qual double")


def de_novo_score(kid: np.ndarray, father: np.ndarray, mother: np.ndarray, mutation: float = 1e-8) -> float:
    """-10 log10 of one minus the largest share that a genotype combination with a new allele has, over biallelic diploid
    genotypes; phred-scaled likelihoods RR, RA, AA of each. A transmission that needs a mutation has its rate as prior."""
    lk = [np.asarray(x, float) * PHRED_TO_LN for x in (kid, father, mother)]
    gametes = {0: {0: 1.0}, 1: {0: 0.5, 1: 0.5}, 2: {1: 1.0}}
    terms, new = [], []
    for k, f, m in itertools.product(range(3), repeat=3):
        prior = sum(gametes[f].get(a, 0) * gametes[m].get(b, 0) for a in (0, 1) for b in (0, 1) if a + b == k)
        fresh = prior == 0
        v = lk[0][k] + lk[1][f] + lk[2][m] + np.log(mutation if fresh else prior)
        terms.append(v)
        if fresh:
            new.append(v)
    share = np.exp(max(new) - np.logaddexp.reduce(terms))
    return float(-10 * np.log10(max(1e-30, 1 - share)))


# Codes for unordered pairs of bases.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def apply_variants(seq: str, variants: list[tuple[int, str, str]], first: int = 1, mask: list[tuple[int, int]] = (), mark_del: str | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """The sequence with sorted (pos, ref, alt) applied, later ones that overlap skipped, and a chain of (length, gap in the
    reference, gap in the result). Masked positions become N first."""
    s = list(seq)
    for b, e in mask:
        for i in range(max(b, first), min(e, first + len(seq) - 1) + 1):
            s[i - first] = "N"
    out, chain, at, block = [], [], 0, 0
    for pos, ref, alt in variants:
        i = pos - first
        if i < at or i + len(ref) > len(s) or seq[i : i + len(ref)].upper() != ref.upper():
            continue
        if mark_del and len(alt) < len(ref):
            alt = alt + mark_del * (len(ref) - len(alt))
        out.append("".join(s[at:i]))
        out.append(alt)
        shared = min(len(ref), len(alt))
        block += i - at + shared
        if len(ref) != len(alt):
            chain.append((block, len(ref) - shared, len(alt) - shared))
            block = 0
        at = i + len(ref)
    out.append("".join(s[at:]))
    chain.append((block + len(s) - at, 0, 0))
    return "".join(out), chain


def consensus(variants: DataFrame, fasta: DataFrame, haplotype: str = "A") -> DataFrame:
    """chrom, seq: contigs with their variants applied. haplotype: 1 or 2 (that allele of the first sample), R or A (REF or ALT in
    a het), I (codes for heterozygous SNPs), or None of the genotypes where there are none: first ALT."""
    rows = variants.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", *(["gt"] if "gt" in variants.columns else [])))).alias("v"))

    def pick(v) -> str | None:
        alleles = [v["ref"], *v["alt"]]
        gt = v["gt"] if "gt" in v else None
        if gt is None or not len(gt):
            return v["alt"][0] if len(v["alt"]) else None
        if any(a is None or a != a for a in gt):
            return None
        gt = [int(a) for a in gt]
        if haplotype in ("1", "2"):
            return alleles[gt[min(int(haplotype), len(gt)) - 1]]
        if len(set(gt)) == 1:
            return alleles[gt[0]]
        if haplotype == "I" and all(len(alleles[a]) == 1 for a in gt):
            return IUPAC.get("".join(sorted(alleles[a].upper() for a in gt)), alleles[gt[-1]])
        return alleles[0] if haplotype == "R" else alleles[max(gt)]

    def run(batches):
        for pdf in batches:
            done = []
            for seq, vs in zip(pdf["seq"], pdf["v"]):
                todo = [(x["pos"], x["ref"], a) for x in (vs if vs is not None else ()) if (a := pick(x)) is not None and a != x["ref"]]
                done.append(apply_variants(seq, todo)[0])
            yield pdf[["chrom"]].assign(seq=done)

    return fasta.join(rows, "chrom", "left").select("chrom", "seq", "v").mapInPandas(run, "chrom string, seq string")
