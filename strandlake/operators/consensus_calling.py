"""Calling by the allele-count spectrum: how likely the data of all samples are for each number of ALT copies among them.

The spectrum is a convolution, a sample at a time: with z[k] the likelihood of k copies in the samples so far, a sample of two copies adds
L(RR) z[k] + 2 L(RA) z[k-1] + L(AA) z[k-2]; divided by the number of ways to place k copies it is the likelihood of the count, whatever
the genotypes. With a prior of counts it gives the probability that a site varies at all. The frequency is the most likely one under
Hardy-Weinberg, by expectation and maximisation from several starts; two groups are compared by the likelihood ratio of one frequency against two.

Sites are stacked in an Arrow batch, so each step is a few array operations for all of them. A row's work is in proportion to the square of
its samples.

Defined results: a sample whose likelihoods are null, or have a null among them, is not there; one with two values has one copy, one with
three has two, others are not there; all-equal likelihoods say nothing but count; a row without any sample has null results; values are phred
scaled, of any height (they are set off against the sample's best one, as only ratios matter)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIORS = ("full", "flat", "half")


def prior(m: int, kind: str = "full", theta: float = 1e-3) -> np.ndarray:
    """Prior of 0 to m copies. full: theta / k for k copies, the rest for none; flat: all alike; half: falling evenly with the count."""
    if kind == "flat":
        return np.full(m + 1, 1 / (m + 1))
    if kind == "half":
        return 2 * (m + 1 - np.arange(m + 1)) / (m + 1) / (m + 2)
    if kind != "full":
        raise ValueError(f"{kind} is none of {PRIORS}")
    p = theta / np.maximum(1, np.arange(m + 1))
    p[0] = 1 - p[1:].sum()
    return p


def ways(m: int) -> np.ndarray:
    """Logarithms of the binomial coefficients of m."""
    f = np.array([math.lgamma(k + 1) for k in range(m + 1)])
    return f[m] - f - f[::-1]


def terms(lik: np.ndarray, ploidy: np.ndarray) -> np.ndarray:
    """By site and sample, the factors of z[k], z[k-1] and z[k-2]."""
    out = lik * np.array([1.0, 2.0, 1.0])
    out[ploidy == 1] = lik[ploidy == 1] * np.array([1.0, 1.0, 0.0])
    out[ploidy == 0] = [1.0, 0.0, 0.0]
    return out


def spectrum(lik: np.ndarray, ploidy: np.ndarray) -> np.ndarray:
    """By site, the likelihood of each count but for a factor of the site; lik: (sites, samples, 3), ploidy: (sites, samples)."""
    c, m = terms(lik, ploidy), ploidy.sum(1)
    z = np.zeros((len(lik), int(m.max(initial=0)) + 1))
    z[:, 0] = 1
    for j in range(lik.shape[1]):
        new = z * c[:, j, :1]
        new[:, 1:] += z[:, :-1] * c[:, j, 1:2]
        new[:, 2:] += z[:, :-2] * c[:, j, 2:]
        z = new / np.maximum(new.max(1, keepdims=True), 1e-300)
    out = np.zeros_like(z)
    for n in np.unique(m):
        rows = m == n
        log = np.log(np.maximum(z[rows, : n + 1], 1e-300)) - ways(int(n))
        out[rows, : n + 1] = np.where(z[rows, : n + 1] > 0, np.exp(log - log.max(1, keepdims=True)), 0)
    return out


def genotype_prior(f: np.ndarray, ploidy: np.ndarray) -> np.ndarray:
    """Hardy-Weinberg by site and sample."""
    q = 1 - f
    two = np.stack([q * q, 2 * f * q, f * f], -1)[:, None, :]
    one = np.stack([q, f, np.zeros_like(f)], -1)[:, None, :]
    return np.where((ploidy == 2)[:, :, None], two, np.where((ploidy == 1)[:, :, None], one, np.array([1.0, 0.0, 0.0])))


STARTS = (0.02, 0.25, 0.5, 0.75, 0.98)  # likelihoods of a frequency may have more than one top


def frequency(lik: np.ndarray, ploidy: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """By site, the best of the frequencies after so many rounds from each of STARTS, and its log likelihood (0 where there is no sample)."""
    m = np.maximum(ploidy.sum(1), 1)
    here = ploidy > 0
    best_f, best = np.full(len(lik), STARTS[0]), np.full(len(lik), -np.inf)
    for start in STARTS:
        f = np.full(len(lik), start)
        for _ in range(rounds):
            p = lik * genotype_prior(f, ploidy)
            p /= np.maximum(p.sum(2, keepdims=True), 1e-300)
            f = (np.where(here, p[:, :, 1] + 2 * p[:, :, 2], 0)).sum(1) / m
        total = np.where(here, np.log(np.maximum((lik * genotype_prior(f, ploidy)).sum(2), 1e-300)), 0).sum(1)
        better = total > best + 1e-9
        best_f, best = np.where(better, f, best_f), np.where(better, total, best)
    return best_f, best


def chi2_tail(x: float) -> float:
    """Of one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def likelihoods(pls: list) -> tuple[np.ndarray, np.ndarray]:
    """(lik, ploidy) of sites with lists of likelihoods by sample, padded to the longest list."""
    n = max((len(p or []) for p in pls), default=0)
    lik, ploidy = np.ones((len(pls), n, 3)), np.zeros((len(pls), n), int)
    for i, site in enumerate(pls):
        for j, pl in enumerate(site or []):
            if pl is None or len(pl) not in (2, 3) or any(x is None for x in pl):
                continue
            least = min(pl)
            lik[i, j] = [10 ** (-(x - least) / 10) for x in pl] + [0.0] * (3 - len(pl))
            ploidy[i, j] = len(pl) - 1
    return lik, ploidy


RESULT = T.StructType([T.StructField("qual", T.DoubleType()), T.StructField("p_ref", T.DoubleType()), T.StructField("ac", T.IntegerType()), T.StructField("an", T.IntegerType()), T.StructField("af", T.DoubleType()), T.StructField("lrt", T.DoubleType()), T.StructField("p_lrt", T.DoubleType()), T.StructField("gt", T.ArrayType(T.IntegerType())), T.StructField("gq", T.ArrayType(T.IntegerType())), T.StructField("spectrum", T.ArrayType(T.DoubleType()))])


def call_spectrum(df: DataFrame, field: str = "PL", names: str = "sample", group: list[str] | None = None, kind: str = "full", theta: float = 1e-3, rounds: int = 50, chunk: int = 2048) -> DataFrame:
    """Adds call: qual (phred of p_ref, at most 999), p_ref (probability of no copy), ac (the likeliest count), an (copies in all), af (the likeliest
    frequency), lrt and p_lrt (of the samples in `group` having another frequency than the others; null without group), gt and gq (by
    sample: copies of the ALT in its likeliest genotype and phred of the others, -1 where it is not there), spectrum (by count, its
    posterior probability)."""
    cols = df.columns
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), F.transform("samples", lambda s: s[field].cast("array<double>")).alias("pl"), F.transform("samples", lambda s: s[names].isin(group) if group is not None else F.lit(False)).alias("mine"))
    priors: dict[int, np.ndarray] = {}

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, chunk):
                b = whole.slice(k, chunk)
                pls, mine = b.column(1).to_pylist(), b.column(2).to_pylist()
                lik, ploidy = likelihoods(pls)
                m = ploidy.sum(1)
                post = spectrum(lik, ploidy)
                ac = post.argmax(1)
                for n in np.unique(m).tolist():
                    if n not in priors:
                        priors[n] = prior(n, kind, theta)
                    post[m == n, : n + 1] *= priors[n]
                post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
                f, log = frequency(lik, ploidy, rounds)
                ratio = np.zeros(len(pls))
                if group is not None:
                    inside = np.zeros(ploidy.shape, bool)
                    for i, x in enumerate(mine):
                        inside[i, : len(x or [])] = x or []
                    ratio = 2 * (frequency(lik, np.where(inside, ploidy, 0), rounds)[1] + frequency(lik, np.where(inside, 0, ploidy), rounds)[1] - log)
                g = lik * genotype_prior(f, ploidy)
                g /= np.maximum(g.sum(2, keepdims=True), 1e-300)
                best = g.argmax(2)
                sure = np.minimum(99, np.floor(-10 * np.log10(np.maximum(1 - g.max(2), 1e-10)) + 1e-9)).astype(int)
                out = []
                for i in range(len(pls)):
                    if not m[i]:
                        out.append(None)
                        continue
                    here = ploidy[i, : len(pls[i])] > 0
                    lrt = max(0.0, float(ratio[i])) if group is not None else None
                    out.append({"qual": min(999.0, -10 * math.log10(max(post[i, 0], 1e-100))), "p_ref": float(post[i, 0]), "ac": int(ac[i]), "an": int(m[i]), "af": float(f[i]), "lrt": lrt, "p_lrt": chi2_tail(lrt) if lrt is not None else None, "gt": np.where(here, best[i, : len(here)], -1).tolist(), "gq": np.where(here, sure[i, : len(here)], -1).tolist(), "spectrum": post[i, : m[i] + 1].tolist()})
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, CALL)], ["row", "call"])

    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("call", RESULT)])
    return packed.mapInArrow(run, schema).select("row.*", "call")


CALL = pa.struct([("qual", pa.float64()), ("p_ref", pa.float64()), ("ac", pa.int32()), ("an", pa.int32()), ("af", pa.float64()), ("lrt", pa.float64()), ("p_lrt", pa.float64()), ("gt", pa.list_(pa.int32())), ("gq", pa.list_(pa.int32())), ("spectrum", pa.list_(pa.float64()))])
