"""Copy numbers of whole contigs, also of a fraction of cells, from the peaks of a histogram of B-allele frequencies.

With two copies heterozygous sites lie at 1/2; with three copies in the fraction f of the cells at 1/(2+f) and (1+f)/(2+f); with four at 1/2 and, where three
of the four are alike, at 1/(2+2f) and (1+2f)/(2+2f). Each model is fitted by damped least squares (Levenberg-Marquardt) with its centres
tied to the one distance that f stands for; a larger model must fit better by a factor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histograms(df: DataFrame, keys: list[str], baf: str = "baf", bins: int = 100) -> DataFrame:
    """keys and hist, the numbers of frequencies in equal parts of [0, 1] (1 counts to the last); others and nulls do not count."""
    if bins < 10:
        raise ValueError("there are ten bins at least")
    b = F.least(F.floor(F.col(baf) * bins), F.lit(bins - 1))
    x = df.filter((F.col(baf) >= 0) & (F.col(baf) <= 1) & ~F.isnan(F.col(baf).cast("double"))).groupBy(*keys, b.cast("int").alias("_b")).agg(F.count("*").alias("_n"))
    g = x.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_m"))
    return g.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0).cast("long"))).alias("hist"))


def curve(x: np.ndarray, copies: int, p: np.ndarray) -> np.ndarray:
    """Height of the model at x. p: width, height of the outer peaks (of the only one with two copies), their distance from 1/2, height at 1/2 (four copies)."""
    bell = lambda m: np.exp(-((x - m) ** 2) / (2 * p[0] ** 2))
    if copies == 2:
        return p[1] * bell(0.5)
    outer = p[1] * (bell(0.5 - p[2]) + bell(0.5 + p[2]))
    return outer if copies == 3 else outer + p[3] * bell(0.5)


def distance(copies: int, fraction: float) -> float:
    return 0.5 - 1 / (2 + (copies - 2) * fraction)


def fraction_of(copies: int, d: float) -> float:
    return (1 / (0.5 - d) - 2) / (copies - 2)


def least_squares(x: np.ndarray, y: np.ndarray, copies: int, begin: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Parameters within their bounds and the sum of squares: steps of Gauss and Newton, damped more after one that does not help."""
    p, damp = np.clip(begin, low, high), 1e-2
    loss = float(((y - curve(x, copies, p)) ** 2).sum())
    for _ in range(rounds):
        r, step = y - curve(x, copies, p), 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.stack([(curve(x, copies, p + step * e) - curve(x, copies, p - step * e)) / (2 * s) for e, s in zip(np.eye(len(p)), step)], 1)
        a = j.T @ j
        new = np.clip(p + np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), j.T @ r), low, high)
        next_ = float(((y - curve(x, copies, new)) ** 2).sum())
        if next_ < loss:
            done, p, loss, damp = loss - next_ < 1e-10 * loss, new, next_, max(damp / 5, 1e-9)
            if done:
                break
        elif damp > 1e8:
            break
        else:
            damp *= 5
    return p, loss


def fitted(hist: np.ndarray, edge: float, peak: float, penalty: float, least: float) -> tuple[float | None, float | None, float | None]:
    """(copies, fraction, error) of one histogram; error: what the model leaves unexplained of the heterozygous sites."""
    n = len(hist)
    x = (np.arange(n) + 0.5) / n
    inner = (x > edge) & (x < 1 - edge)
    y, alt = hist[inner].astype(float), float(hist[x >= 1 - edge].sum())
    if y.sum() + alt == 0:
        return None, None, None
    if y.sum() < peak * alt:
        return 1.0, 1.0, None
    x, total = x[inner], y.sum()
    y = y / y.max()
    scale, best = y.sum(), None
    for copies in (2, 3, 4):
        if copies == 2:
            tries = [([0.05, 1.0], [0.005, 0], [0.12, 3])]
        else:
            span = [distance(copies, least), distance(copies, 1.0)]
            tries = [([0.04, 1.0, d] + [0.5] * (copies - 3), [0.005, 0, span[0]] + [0] * (copies - 3), [0.12, 3, span[1]] + [3] * (copies - 3)) for d in np.linspace(*span, 4)]
        p, _ = min((least_squares(x, y, copies, *map(np.array, t)) for t in tries), key=lambda r: r[1])
        error = float(np.abs(y - curve(x, copies, p)).sum() / scale)
        if best is None or error < penalty * best[2]:
            best = (float(copies), 1.0 if copies == 2 else fraction_of(copies, p[2]), error)
    return best if total > 0 else (None, None, None)


def peak_copies(df: DataFrame, keys: list[str], baf: str = "baf", bins: int = 100, edge: float = 0.12, peak: float = 0.1, penalty: float = 0.7, least: float = 0.1) -> DataFrame:
    """keys, copies (1 to 4), fraction (of cells that have them), mean_copies (of all cells), error, sites.

    edge: what counts as homozygous at either end; peak: heterozygous sites there must be for more than one copy, to homozygous ALT ones; penalty: a model of
    more copies must leave less than this part of the error; least: smallest fraction that is looked for. Groups without a
    frequency have no row; those with homozygous REF sites only have null copies. What is fitted is a group's histogram, a row of fixed size."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches):
        for pdf in batches:
            rows = [fitted(np.asarray(h, np.int64), edge, peak, penalty, least) for h in pdf["hist"]]
            out = pd.DataFrame(rows, columns=["copies", "fraction", "error"], dtype=object)
            yield pd.concat([pdf[keys], out.astype(float), pdf["hist"].map(sum).rename("sites")], axis=1)

    out = histograms(df, keys, baf, bins).mapInPandas(run, f"{kinds}, copies double, fraction double, error double, sites long")
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("copies", "fraction", "error")}
    return out.withColumns(clean).withColumn("mean_copies", 2 + F.when(F.col("copies") == 1, -1.0).otherwise(F.col("copies") - 2) * F.col("fraction"))
