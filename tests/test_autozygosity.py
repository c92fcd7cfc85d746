"""Frequencies, emissions, crossovers and runs of the autozygosity model."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import autozygosity as az

RNG = random.Random(6)
SCHEMA = "chrom string, pos bigint, ref string, alt array<string>, AF array<double>, AC array<int>, AN int, samples array<struct<sample:string,gt:array<int>,PL:array<int>>>"


def site(pos, samples, alt=("G",), af=None, ac=None, an=None):
    return ("1", pos, "A", list(alt), af, ac, an, [(f"s{k}", gt, pl) for k, (gt, pl) in enumerate(samples)])


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        site(1, [([0, 1], [30, 0, 40]), ([1, 1], [90, 9, 0]), ([None, 1], None)], af=[0.25], ac=[3], an=4),
        site(2, [([0, 0], [0, 9, 90]), ([0, 0], [5, 5, 5]), ([0, 0], [0, 3, -1])], af=[None], ac=[0], an=6),
        site(3, [([1, 1], [300, 20, 0]), ([0, 2], [0, 0, 0]), ([0, 1], [0, 10, 20])], alt=("G", "<*>"), af=[0.5, 0.1], ac=None, an=0),
        site(4, [([0, 1], [1, 0, 1]), ([0], [0, 1]), ([1, 0], [20, 0, 20])], alt=("G", "T"), af=[0.9, 0.1], ac=[1, 1], an=6),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ph(*pl):
    p = [10 ** (-min(x, 255) / 10) for x in pl]
    return [x / sum(p) for x in p]


def test_frequencies(spark, df):
    of = lambda *a, **k: {r["pos"]: round(r["af"], 9) for r in az.frequency(df, *a, **k).collect()}
    assert of("tag") == {1: 0.25, 3: 0.5, 4: 0.9}
    assert of("tag", default=0.1) == {1: 0.25, 2: 0.1, 3: 0.5, 4: 0.9}
    assert of("counts") == {1: 0.75, 4: round(1 / 6, 9)}
    assert of("genotypes") == {1: 0.75, 3: round(4 / 6, 9), 4: 0.5}
    assert of("genotypes", of=["s0"]) == {1: 0.5, 3: 1.0, 4: 0.5}
    mean = lambda *ps: round(sum(p[1] / 2 + p[2] for p in ps) / len(ps), 9)
    assert of("likelihoods") == {1: mean(ph(30, 0, 40), ph(90, 9, 0)), 2: mean(ph(0, 9, 90)), 3: mean(ph(300, 20, 0), ph(0, 10, 20)), 4: mean(ph(1, 0, 1), ph(20, 0, 20))}
    table = spark.createDataFrame([("1", 1, "A", "G", 0.3), ("1", 1, "A", "G", 0.2), ("1", 3, "A", "T", 0.4), ("2", 4, "A", "G", 0.4)], "chrom string, pos bigint, ref string, alt string, af double")
    assert of("table", table=table) == {1: 0.2} and of("table", table=table, default=0.5) == {1: 0.2, 2: 0.5, 3: 0.5, 4: 0.5}
    assert of("default", default=0.4) == dict.fromkeys((1, 2, 3, 4), 0.4)
    with pytest.raises(ValueError):
        az.frequency(df, "guess")


def test_emissions(df):
    x = az.frequency(df, "default", default=0.4)
    hw, hom = lambda p: 0.36 * p[0] + 0.48 * p[1] + 0.16 * p[2], lambda p: 0.6 * p[0] + 0.4 * p[2]
    got = {(r["sample"], r["pos"]): (r["hw"], r["az"]) for r in az.emissions(x).collect()}
    want = {("s0", 1): ph(30, 0, 40), ("s1", 1): ph(90, 9, 0), ("s0", 2): ph(0, 9, 90), ("s0", 3): ph(300, 20, 0), ("s2", 3): ph(0, 10, 20)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx((hw(p), hom(p))) for k, p in want.items())
    e = 0.001
    rr, ra, aa = [1 - e - e * e, e, e * e], [e, 1 - 2 * e, e], [e * e, e, 1 - e - e * e]
    calls = {("s0", 1): ra, ("s1", 1): aa, ("s0", 2): rr, ("s1", 2): rr, ("s2", 2): rr, ("s0", 3): aa, ("s1", 3): ra, ("s2", 3): ra}
    got = {(r["sample"], r["pos"]): (r["hw"], r["az"]) for r in az.emissions(x, error=e).collect()}
    assert got.keys() == calls.keys() and all(got[k] == pytest.approx((hw(p), hom(p))) for k, p in calls.items())
    assert {(r["sample"], r["pos"]) for r in az.emissions(x, error=e, skip_reference=True).collect()} == {k for k, p in calls.items() if p is not rr}


def planted(spark, length=600):
    """One sample of three has a stretch without heterozygous sites."""
    rows = []
    for pos in range(10, length * 10, 10):
        gts = [[int(RNG.random() < 0.5), int(RNG.random() < 0.5)] for _ in range(3)]
        if 2000 <= pos < 4000:
            gts[1][1] = gts[1][0]
        rows.append(site(pos, [(g, None) for g in gts]))
    return spark.createDataFrame(rows, SCHEMA)


def test_planted_run(spark):
    x = az.emissions(az.frequency(planted(spark), "default", default=0.5), error=0.001)
    found = []
    for width in (1 << 20, 333):
        out = az.runs(az.autozygous(x, 1e-3, 1e-3, width=width), width).collect()
        found.append(sorted((r["sample"], r["beg"], r["end"], r["sites"], round(r["quality"], 4)) for r in out))
    assert found[0] == found[1]
    (run,) = [r for r in found[0] if r[3] > 30]
    assert run[0] == "s1" and abs(run[1] - 2000) < 150 and abs(run[2] - 3990) < 150 and run[4] > 20


def test_crossovers(spark):
    """A map without recombination keeps one state throughout; a flat one is like a rate by base."""
    x = az.emissions(az.frequency(planted(spark, 200), "default", default=0.5), error=0.001)
    flat = spark.createDataFrame([("1", 1, 0.0), ("1", 100_000, 0.0)], "chrom string, pos bigint, cm double")
    states = lambda **k: {(r["sample"], r["pos"]): (r["state"], round(r["quality"], 6)) for r in az.autozygous(x, 0.05, 0.05, **k).collect()}
    one = states(genetic_map=flat)
    assert all(len({one[k][0] for k in one if k[0] == s}) == 1 for s in ("s0", "s1", "s2"))
    even = spark.createDataFrame([("1", 1, 0.0), ("1", 1001, 10.0), ("1", 100_001, 1000.0)], "chrom string, pos bigint, cm double")
    assert states(genetic_map=even) == states(rate=1e-4) == states(rate=1e-4, width=77)
    at = even.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("double").alias("x"), F.col("cm").alias("y")))).alias("_map")).withColumn("p", F.explode(F.array(*map(F.lit, (-5, 1, 501, 50_501, 200_000)))))
    assert [r[0] for r in at.select(az.centimorgans(F.col("p"))).collect()] == [0.0, 0.0, 5.0, 505.0, 1000.0]
