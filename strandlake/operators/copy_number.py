"""Copy numbers along contigs from B-allele frequencies and log R ratios of a sample, or of a sample and its control: a hidden Markov
model with the states 0, 1, 2 and 3 copies (16 pairs of them with a control), decoded by tiles (see hmm.decode).

Emissions are expressions of the row. A loss shows allele frequencies at 0 and 1, two copies at 0, 1/2 and 1, a gain in the fraction f of all
cells at 0, 1/(2+f), (1+f)/(2+f) and 1. A site without an allele frequency (null or negative) speaks for no copies at all."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import hmm
from strandlake.operators.segments import moving_average, stretches
from strandlake.session import scratch_path

N = 4
# Shares of the genotypes RR, RA and AA where a site's ALT frequency is not known; centres of the log R ratio with one, two and three copies.
SHARES = (0.76, 0.14, 0.098)
CENTRES = (-0.45, 0.0, 0.3)


def transition(change: float = 1e-9) -> list[list[float]]:
    """Of one sample: each other number of copies with the same probability."""
    return np.where(np.eye(N) > 0, 1 - (N - 1) * change, change).tolist()


def paired_transition(change: float = 1e-9, same: float = 0.5) -> list[list[float]]:
    """Of a sample and its control, state = copies * 4 + copies of the control. same: how much the two are held to have equal numbers."""
    total = (N - 1) * change
    one = np.where(np.eye(N) > 0, 1 - total, total / (N * N - 1))
    t = np.kron(one, one)
    alike = np.eye(N).ravel() > 0
    t = np.where(alike[None, :], np.where(alike[:, None], (1 - same) * t + same * np.sqrt(t), t), (1 - same) * t)
    return (t / t.sum(1, keepdims=True)).tolist()


def start(control: bool = False, same: float = 0.5) -> list[float]:
    one = np.array([0.5 / 3, 0.5 / 3, 0.5, 0.5 / 3])
    if not control:
        return one.tolist()
    p = np.kron(one, one) * np.where(np.eye(N).ravel() > 0, 1, 1 - same)
    return (p / p.sum()).tolist()


def peaks(fraction: float, dev: float) -> dict[str, float]:
    """dev2, the centre of the lower band of a gain (the upper lies as far from 1), and the parts of the bell curves at 0 (or 1), 1/2 and that band that
    lie between 0 and 1."""
    inside = lambda m: 0.5 * (math.erf((1 - m) / (dev * math.sqrt(2))) + math.erf(m / (dev * math.sqrt(2))))
    low = 1 / (2 + fraction)
    return {"dev2": dev * dev, "low": low, "in_edge": inside(0), "in_half": inside(0.5), "in_low": inside(low)}


def likelihoods(baf: Column, lrr: Column, peak: dict[str, Column], af: Column | None = None, baf_weight: float = 1.0, lrr_weight: float = 0.2, lrr_dev: float = 0.2, error: float = 1e-4) -> list[Column]:
    """Of 0, 1, 2 and 3 copies. af: ALT frequency of the site. The two kinds of evidence count by their weights, `error` in any case."""
    rr, ra, aa = ((1 - af) * (1 - af), 2 * af * (1 - af), af * af) if af is not None else map(F.lit, SHARES)
    bell = lambda m, part: F.exp(-(baf - m) * (baf - m) * 0.5 / peak["dev2"]) / part / F.sqrt(2 * math.pi * peak["dev2"])
    at_0, at_1, half = bell(F.lit(0.0), peak["in_edge"]), bell(F.lit(1.0), peak["in_edge"]), bell(F.lit(0.5), peak["in_half"])
    low, high = bell(peak["low"], peak["in_low"]), bell(1 - peak["low"], peak["in_low"])
    by = [at_0 * (rr + ra * 0.5) + at_1 * (aa + ra * 0.5), at_0 * rr + half * ra + at_1 * aa, at_0 * rr + (low + high) * ra * 0.5 + at_1 * aa]
    total = by[0] + by[1] + by[2]
    ratio = F.coalesce(lrr, F.lit(0.0)) if lrr_weight > 0 else F.lit(0.0)
    out = [F.lit(0.0)]
    for b, c in zip(by, CENTRES):
        share = F.when(total > 0, b / total).otherwise(1 / 3)
        out.append(error + (1 - baf_weight + baf_weight * share) * (1 - lrr_weight + lrr_weight * F.exp(-(ratio - c) * (ratio - c) / (lrr_dev * lrr_dev))))
    called = baf.isNotNull() & (baf >= 0)
    return [F.when(called, p).otherwise(0.5 if k == 0 else 0.5 / 3) for k, p in enumerate(out)]


def _with_peaks(params: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """Adds to each group's fraction and deviation (of each side) what likelihoods needs; a few numbers a group."""
    names = [f"{s}_{n}" for s in sides for n in ("dev2", "low", "in_edge", "in_half", "in_low")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in params.schema)

    def run(batches):
        for pdf in batches:
            for s in sides:
                more = pd.DataFrame([peaks(f, d) for f, d in zip(pdf[f"{s}_fraction"], pdf[f"{s}_dev"])], columns=["dev2", "low", "in_edge", "in_half", "in_low"])
                pdf = pdf.assign(**{f"{s}_{n}": more[n].to_numpy() for n in more})
            yield pdf

    return params.mapInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys, of which nulls are equal."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(right, on, "left").drop(*(f"_r_{k}" for k in keys))


def _improved(states: DataFrame, params: DataFrame, keys: list[str], at: str, side: str, least: float, window: int, dev: float, width: int) -> DataFrame:
    """The parameters with this side's fraction and deviation from the band that three copies show, weighted by the (smoothed) probability of three
    copies; {side}_done where the fraction moved by less than a tenth, or the band cannot be told from that of two copies."""
    baf = F.col(f"{side}_baf")
    folded = F.when(baf > 0.5, 1 - baf).otherwise(baf)
    third = sum((F.get("probs", F.lit(i)) for i in ([3] if side == "query" and "control_baf" not in states.columns else [12, 13, 14, 15] if side == "query" else [3, 7, 11, 15])), F.lit(0.0))
    bands = states.filter((baf >= 0.2) & (baf <= 0.8)).select(*keys, at, folded.alias("_b"), third.alias("_p"))
    bands = moving_average(bands, keys, at, "_p", window // 2, window - window // 2 - 1, "_w", width)
    some = bands.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_b")).alias("_s"), F.sum(F.col("_w") * F.col("_b") * F.col("_b")).alias("_q"))
    edge = states.filter(baf > 0.8).groupBy(*keys).agg(F.avg((1 - baf) * (1 - baf)).alias("_edge"))
    x = _joined(_joined(params, some, keys), edge, keys)
    mean = F.col("_s") / F.col("_n")
    dev2 = F.greatest(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)), F.coalesce("_edge", F.lit(0.0)))
    x = x.withColumn("_mean", F.when(F.col("_n") > 0, mean)).withColumn("_dev2", F.when(F.col("_n") > 0, dev2)).withColumn("_new", 1 / F.col("_mean") - 2)
    # 1.644854: the normal distribution's quantile of 0.95
    lost = F.col("_mean").isNull() | (F.col("_mean") > 0.5 - F.sqrt("_dev2") * 1.644854) | (F.col("_new") < least)
    new = F.when(lost, 1.0).otherwise(F.least(F.col("_new"), F.lit(1.0)))
    wide = F.when(lost, F.col(f"{side}_dev")).otherwise(F.sqrt(F.greatest(F.least(F.col("_dev2"), F.lit(3 * dev * dev)), F.lit(0.5 * dev * dev))))
    done = F.col(f"{side}_done") | lost | (F.abs(new - F.col(f"{side}_fraction")) < 0.1)
    moved = {f"{side}_fraction": new, f"{side}_dev": wide}
    x = x.withColumn("_done", done)
    for c, v in moved.items():
        x = x.withColumn(f"_to_{c}", F.when(F.col(f"{side}_done"), F.col(c)).otherwise(v))
    for c in moved:
        x = x.withColumn(c, F.col(f"_to_{c}"))
    return x.withColumn(f"{side}_done", F.col("_done")).select(*params.columns)


def copy_numbers(
    df: DataFrame, keys: list[str], at: str = "pos", baf: str = "baf", lrr: str = "lrr", control: tuple[str, str] | None = None, af: str | None = None, change: float = 1e-9, same: float = 0.5, baf_dev: float = 0.04,
    lrr_dev: float = 0.2, baf_weight: float = 1.0, lrr_weight: float = 0.2, error: float = 1e-4, smooth: int = 10, fraction: float = 1.0, least_fraction: float | None = None, rounds: int = 10, width: int = hmm.WIDTH,
) -> DataFrame:
    """keys, at, query_baf, cn, prob, query_fraction, query_dev; with control (its columns of frequency and ratio) also control_baf, cn_control, control_fraction,
    control_dev. A group (sample and contig) has parameters of its own, its positions are unique.

    smooth: rows of the moving average of the ratios. least_fraction: the fraction of cells with a gain and the deviation of its bands are fitted, down to this
    fraction: a round decodes, adds up a few numbers a group where the groups are, and moves the parameters, which stay a table, until no group's
    fraction moves (or `rounds`). Null ratios count as nought; an empty table gives an empty one."""
    sides = ["query", "control"] if control else ["query"]
    of = {"query": (baf, lrr), "control": control}
    x = df.select(*keys, at, *(F.col(of[s][k]).cast("double").alias(f"{s}_{n}") for s in sides for k, n in enumerate(("baf", "lrr"))), *([F.col(af).cast("double").alias("_af")] if af else []))
    for s in sides:
        x = x.withColumn(f"{s}_lrr", F.coalesce(f"{s}_lrr", F.lit(0.0)))
        if smooth > 1:
            x = moving_average(x, keys, at, f"{s}_lrr", smooth // 2, smooth - smooth // 2 - 1, "_mean", width).drop(f"{s}_lrr").withColumnRenamed("_mean", f"{s}_lrr")
    x = _kept(x, "copies-sites")
    params = x.select(*keys).distinct().select(*keys, *(v for s in sides for v in (F.lit(fraction).alias(f"{s}_fraction"), F.lit(baf_dev).alias(f"{s}_dev"), F.lit(least_fraction is None).alias(f"{s}_done"))))
    params = _kept(params, "copies-params")
    t, init = (paired_transition(change, same), start(True, same)) if control else (transition(change), start())
    for left in range(rounds if least_fraction is not None else 0, -1, -1):
        y = _joined(x, _with_peaks(params, keys, sides), keys)
        each = {s: likelihoods(F.col(f"{s}_baf"), F.col(f"{s}_lrr"), {n: F.col(f"{s}_{n}") for n in ("dev2", "low", "in_edge", "in_half", "in_low")}, F.col("_af") if af else None, baf_weight, lrr_weight, lrr_dev, error) for s in sides}
        emit = [a * b for a in each["query"] for b in each["control"]] if control else each["query"]
        y = y.select(*keys, at, *(f"{s}_baf" for s in sides), *(e.alias(f"_e{k}") for k, e in enumerate(emit)))
        states = hmm.decode(y, keys, at, [f"_e{k}" for k in range(len(emit))], t, init, width=width, every=True)
        if not left or params.filter(" AND ".join(f"{s}_done" for s in sides)).count() == params.count():
            break
        states = _joined(states, x.select(*keys, at, *(f"{s}_baf" for s in sides)), [*keys, at])
        for s in sides:
            params = _improved(states, params, keys, at, s, least_fraction, 50, baf_dev, width)
        params = _kept(params, "copies-params")
    out = _joined(_joined(states, x.select(*keys, at, *(f"{s}_baf" for s in sides)), [*keys, at]), params, keys)
    cn = [F.floor(F.col("state") / N).cast("int").alias("cn"), (F.col("state") % N).alias("cn_control")] if control else [F.col("state").alias("cn")]
    return out.select(*keys, at, *(f"{s}_baf" for s in sides), *cn, "prob", *(f"{s}_{n}" for s in sides for n in ("fraction", "dev")))


def copy_regions(states: DataFrame, keys: list[str], at: str = "pos", width: int = hmm.WIDTH) -> DataFrame:
    """keys, beg, end, cn (and cn_control), sites, hets (likely ones, by allele frequencies between 1/4 and 3/4; also of the control), quality (phred of the
    mean probability that the number is wrong, 99 at most) of stretches of equal numbers."""
    sides = [s for s in ("query", "control") if f"{s}_baf" in states.columns]
    labels = ["cn", "cn_control"] if "control" in sides else ["cn"]
    x = states.select(*keys, at, *labels, (1 - F.col("prob")).alias("_off"), *(((F.col(f"{s}_baf") > 0.25) & (F.col(f"{s}_baf") < 0.75)).cast("int").alias(f"_het_{s}") for s in sides))
    hets = {"query": "hets", "control": "hets_control"}
    out = stretches(x, keys, at, labels, {"off": "_off", **{hets[s]: f"_het_{s}" for s in sides}}, width)
    off = F.col("off") / F.col("sites")
    out = out.withColumn("quality", F.when(off <= 1e-10, 99.0).otherwise(F.least(F.lit(99.0), -10 * F.log10(off))))
    return out.select(*keys, "beg", "end", *labels, "sites", *(F.coalesce(hets[s], F.lit(0)).alias(hets[s]) for s in sides), "quality")
