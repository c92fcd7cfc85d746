"""Peaks of histograms: planted copies and fractions, the fit against a fine grid."""

import numpy as np
import pytest

from strandlake.operators import peak_fit


def sites(rng, copies, fraction, n=6000, dev=0.03):
    g = rng.choice(3, n, p=[0.3, 0.4, 0.3])
    d = 0.0 if copies == 2 else peak_fit.distance(copies, fraction)
    side = rng.choice([-1, 1], n) if copies < 4 else rng.choice([-1, 0, 1], n, p=[0.35, 0.3, 0.35])
    het = 0.5 + d * side if copies > 1 else rng.integers(0, 2, n).astype(float)
    return np.clip(np.where(g == 1, het, g / 2) + rng.normal(0, dev, n), 0, 1)


PLANTED = [(1, 1.0), (2, 1.0), (3, 1.0), (3, 0.6), (3, 0.4), (4, 1.0)]


def test_planted_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k}", float(b)) for k, (c, f) in enumerate(PLANTED) for b in sites(rng, c, f)]
    rows += [("s0", None), ("s0", 1.5), ("s0", float("nan")), ("ref", 0.0), (None, 0.5)]
    df = spark.createDataFrame(rows, "sample string, baf double")
    got = {r.sample: r for r in peak_fit.peak_copies(df, ["sample"]).collect()}
    for k, (c, f) in enumerate(PLANTED):
        r = got[f"s{k}"]
        assert r.copies == c and r.fraction == pytest.approx(f, abs=0.06) and r.sites == 6000, (c, f, r)
    assert got["s3"].mean_copies == pytest.approx(2.6, abs=0.06) and got["s0"].mean_copies == 1
    assert got["ref"].copies is None and got[None].sites == 1
    assert peak_fit.peak_copies(df.limit(0), ["sample"]).count() == 0


def test_histograms(spark):
    rng = np.random.default_rng(2)
    v = [0.0, 1.0, 0.1, 0.0999, *rng.random(500).tolist()]
    h = peak_fit.histograms(spark.createDataFrame([("a", x) for x in v], "k string, baf double"), ["k"], bins=10).first().hist
    assert h == [sum(min(int(x * 10), 9) == k for x in v) for k in range(10)]


def test_fit_against_a_grid():
    """No point of a fine grid of widths, heights and distances is better than the fit."""
    rng = np.random.default_rng(3)
    x = np.linspace(0.13, 0.87, 60)
    y = peak_fit.curve(x, 3, np.array([0.05, 0.9, 0.11])) + rng.normal(0, 0.03, 60)
    p, loss = peak_fit.least_squares(x, y, 3, np.array([0.04, 1.0, 0.08]), np.array([0.005, 0, 0.02]), np.array([0.12, 3, 1 / 6]))
    grid = min(((y - peak_fit.curve(x, 3, np.array([s, a, d]))) ** 2).sum() for s in np.linspace(0.04, 0.06, 15) for a in np.linspace(0.8, 1, 15) for d in np.linspace(0.09, 0.13, 21))
    assert loss <= grid + 1e-9 and p == pytest.approx([0.05, 0.9, 0.11], abs=0.02)
    for c in (3, 4):
        assert peak_fit.fraction_of(c, peak_fit.distance(c, 0.37)) == pytest.approx(0.37)
