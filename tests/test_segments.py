"""Moving averages and stretches by tiles, copy numbers, shared segments and site noise, against plain loops and planted cases."""

import itertools
import math

import numpy as np
import pytest

from strandlake.operators import copy_number, sharing, site_noise
from strandlake.operators.segments import moving_average, stretches


@pytest.mark.parametrize("width,block", [(1 << 20, 1 << 15), (37, 8), (5, 1)])
def test_moving_average(spark, width, block):
    rng = np.random.default_rng(1)
    rows = [(k, int(p), float(rng.normal()) if rng.random() > 0.05 else None) for k, n in (("a", 90), ("b", 3), (None, 20)) for p in np.cumsum(rng.integers(1, 30, n))]
    df = spark.createDataFrame(rows, "k string, pos long, x double")
    got = {(r.k, r.pos): r.m for r in moving_average(df, ["k"], "pos", "x", 5, 4, "m", width, block).collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        for i, r in enumerate(own):
            near = [v[2] for v in own[max(0, i - 5) : i + 5] if v[2] is not None]
            assert got[k, r[1]] == pytest.approx(sum(near) / len(near), abs=1e-12)


@pytest.mark.parametrize("width", [1 << 20, 7])
def test_stretches(spark, width):
    rng = np.random.default_rng(2)
    rows = [(k, p, [0, 1, None][rng.integers(3)], int(rng.integers(5))) for k in "ab" for p in range(1, 80)]
    out = stretches(spark.createDataFrame(rows, "k string, pos int, l int, v int"), ["k"], "pos", ["l"], {"s": "v"}, width)
    want = []
    for (k, l), g in itertools.groupby(rows, lambda r: (r[0], r[2])):
        g = list(g)
        want.append((k, l, g[0][1], g[-1][1], len(g), sum(r[3] for r in g)))
    assert sorted(map(repr, map(tuple, out.select("k", "l", "beg", "end", "sites", "s").collect()))) == sorted(map(repr, want))
    assert stretches(out.limit(0).withColumnRenamed("beg", "pos"), ["k"], "pos", ["l"], {}).count() == 0


def bands(rng, copies, n, fraction=1.0, dev=0.04):
    """Allele frequencies and ratios of n sites with so many copies, as an array would read them."""
    g = rng.choice(3, n, p=[0.4, 0.4, 0.2])
    low = 1 / (2 + fraction)
    mean = {1: np.where(g == 1, rng.integers(0, 2, n), g / 2), 2: g / 2, 3: np.where(g == 1, np.where(rng.random(n) < 0.5, low, 1 - low), g / 2)}[copies]
    return np.clip(mean + rng.normal(0, dev, n), 0, 1), {1: -0.45, 2: 0.0, 3: 0.3}[copies] + rng.normal(0, 0.15, n)


def array_rows(rng, plan, sample, fraction=1.0):
    baf, lrr = map(np.concatenate, zip(*(bands(rng, c, n, fraction) for c, n in plan)))
    return [(sample, "1", 100 * (i + 1), float(b), float(v)) for i, (b, v) in enumerate(zip(baf, lrr))]


def test_planted_losses_and_gains(spark):
    rng = np.random.default_rng(3)
    plan = [(2, 300), (1, 120), (2, 200), (3, 150), (2, 230)]
    rows = array_rows(rng, plan, "s")
    rows[20] = (*rows[20][:3], None, None)  # a single failed site is no loss
    df = spark.createDataFrame(rows, "sample string, chrom string, pos long, baf double, lrr double")
    states = copy_number.copy_numbers(df, ["sample", "chrom"], width=20_000).cache()
    out = copy_number.copy_regions(states, ["sample", "chrom"], width=20_000).orderBy("beg").collect()
    assert [r.cn for r in out] == [c for c, _ in plan]
    assert all(abs(r.sites - n) <= 8 for r, (_, n) in zip(out, plan)), out
    assert all(r.quality > 10 for r in out), out
    assert out[1].hets < 5 < out[0].hets
    whole = copy_number.copy_numbers(df, ["sample", "chrom"]).select(*states.columns[:5])
    assert sorted(map(tuple, whole.drop("query_baf").collect())) == sorted(map(tuple, states.select(*whole.columns).drop("query_baf").collect()))
    assert copy_number.copy_numbers(df.limit(0), ["sample", "chrom"]).count() == 0


def test_emissions_against_formulas(spark):
    p = copy_number.peaks(0.7, 0.05)
    cdf = lambda v, m, d: 0.5 * (1 + math.erf((v - m) / (d * math.sqrt(2))))
    bell = lambda b, m: math.exp(-((b - m) ** 2) / (2 * 0.0025)) / (cdf(1, m, 0.05) - cdf(0, m, 0.05)) / math.sqrt(2 * math.pi * 0.0025)
    from pyspark.sql import functions as F

    rows = [(b, v) for b in (0.0, 0.1, 0.37, 0.5, 0.98) for v in (-0.5, 0.02, 0.4)] + [(None, 0.1), (-1.0, None)]
    df = spark.createDataFrame(rows, "b double, v double")
    e = copy_number.likelihoods(F.col("b"), F.col("v"), {k: F.lit(x) for k, x in p.items()}, F.lit(0.3))
    for r in df.select("b", "v", *(c.alias(f"e{k}") for k, c in enumerate(e))).collect():
        got = [r[f"e{k}"] for k in range(4)]
        if r.b is None or r.b < 0:
            assert got == pytest.approx([0.5] + [0.5 / 3] * 3)
            continue
        rr, ra, aa, low = 0.49, 0.42, 0.09, 1 / 2.7
        by = [bell(r.b, 0) * (rr + ra / 2) + bell(r.b, 1) * (aa + ra / 2), bell(r.b, 0) * rr + bell(r.b, 0.5) * ra + bell(r.b, 1) * aa, bell(r.b, 0) * rr + (bell(r.b, low) + bell(r.b, 1 - low)) * ra / 2 + bell(r.b, 1) * aa]
        want = [0.0] + [1e-4 + b / sum(by) * (0.8 + 0.2 * math.exp(-((r.v - c) ** 2) / 0.04)) for b, c in zip(by, (-0.45, 0, 0.3))]
        assert got == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_control_and_fraction(spark):
    """A gain that the control shares and one that it lacks; a gain in some cells only, whose fraction is found."""
    for t in (copy_number.transition(1e-4), copy_number.paired_transition(1e-4, 0.5)):
        assert np.allclose(np.sum(t, 1), 1) and np.min(t) >= 0
    rng = np.random.default_rng(4)
    a = array_rows(rng, [(2, 250), (3, 150), (2, 200), (3, 150), (2, 150)], "s")
    b = array_rows(rng, [(2, 250), (3, 150), (2, 500)], "s")
    df = spark.createDataFrame([(*x, *y[3:]) for x, y in zip(a, b)], "sample string, chrom string, pos long, baf double, lrr double, cbaf double, clrr double")
    s = copy_number.copy_numbers(df, ["sample", "chrom"], control=("cbaf", "clrr"), width=30_000)
    out = copy_number.copy_regions(s, ["sample", "chrom"]).orderBy("beg").collect()
    assert [(r.cn, r.cn_control) for r in out] == [(2, 2), (3, 3), (2, 2), (3, 2), (2, 2)]
    part = spark.createDataFrame(array_rows(rng, [(2, 400), (3, 500), (2, 300)], "s", fraction=0.6), "sample string, chrom string, pos long, baf double, lrr double")
    got = copy_number.copy_numbers(part, ["sample", "chrom"], least_fraction=0.3, width=30_000)
    r = got.first()
    assert r.query_fraction == pytest.approx(0.6, abs=0.1)
    assert [x.cn for x in copy_number.copy_regions(got, ["sample", "chrom"]).orderBy("beg").collect()] == [2, 3, 2]


def test_crossovers_of_a_trio(spark):
    rng = np.random.default_rng(5)
    n, cross_m, cross_f = 400, (130, 300), (220,)
    mother, father = rng.integers(0, 2, (n, 2)), rng.integers(0, 2, (n, 2))
    rows, side = [], [0, 1]
    for i in range(n):
        side = [side[0] ^ (i in cross_m), side[1] ^ (i in cross_f)]
        child = [int(father[i, side[1]]), int(mother[i, side[0]])]  # the first one is the father's
        rows.append(("1", i + 1, child if i % 50 else None, mother[i].tolist(), father[i].tolist()))
    df = spark.createDataFrame(rows, "chrom string, pos long, child array<int>, mother array<int>, father array<int>")
    seg = sharing.trio_segments(df, ["chrom"], switch=1e-6, width=64).orderBy("beg").cache()
    got = seg.collect()
    assert [(r.mother_hap, r.father_hap, r.mother_first) for r in got] == [(1, 2, False), (2, 2, False), (2, 1, False), (1, 1, False)]
    assert [(r.mother_switch, r.father_switch) for r in got] == [(False, False), (True, False), (False, True), (True, False)]
    assert all(abs(r.beg - 1 - c) <= 8 for r, c in zip(got[1:], (130, 220, 300)))
    counts = {r.parent: (r.hets, r.switches) for r in sharing.switches(df, seg, ["chrom"]).collect()}
    het = lambda p: sum(r[3 if p == "mother" else 4][0] != r[3 if p == "mother" else 4][1] for r in rows if r[2])
    assert counts == {"mother": (het("mother"), 2), "father": (het("father"), 1)}
    assert sharing.trio_segments(df.limit(0), ["chrom"]).count() == 0


def test_shared_haplotypes_of_a_pair(spark):
    t = np.array(sharing.pair_transition(1e-3))
    assert np.allclose(t, t.T) and np.allclose(t.sum(1), 1) and t[5, 6] == pytest.approx(1e-6) and t[0, 1] == pytest.approx(1e-3)
    rng = np.random.default_rng(6)
    one, other = rng.integers(0, 2, (600, 2)), rng.integers(0, 2, (600, 2))
    other[200:400, 1] = one[200:400, 0]
    df = spark.createDataFrame([("1", i + 1, one[i].tolist(), other[i].tolist()) for i in range(600)], "chrom string, pos long, one array<int>, other array<int>")
    got = [(r.first_from, r.second_from, r.beg, r.end) for r in sharing.pair_segments(df, ["chrom"], switch=1e-6, width=100).orderBy("beg").collect()]
    inside = [r for r in got if r[3] >= 220 and r[2] <= 380]
    assert len(inside) == 1 and inside[0][:2] == (0, 1) and abs(inside[0][2] - 201) <= 12 and abs(inside[0][3] - 400) <= 12


def test_batches_of_site_noise(spark):
    rng = np.random.default_rng(7)
    sites = [("1", p, "A", a) for p in range(1, 25) for a in ("C", "G", "AT", "ATT")[: 1 + p % 4]]
    rows = [(*s, f"s{k}", int(rng.integers(0, 30)) if k % 9 else None, int(rng.choice([0, 0, 0, 1, 2, 9]))) for s in sites for k in range(40)] + [("1", 99, "A", "C", "s0", 0, 0)]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, sample string, n_ref int, n_alt int")
    whole = site_noise.profile(df, bins=10)
    batches = site_noise.merged([site_noise.profile(df.filter(f"hash(sample) % 5 IN ({k}, -{k})"), bins=10) for k in range(5)], bins=10)
    key = lambda x: sorted((r.chrom, r.pos, r.ref, r.alt, tuple(r.dist), r.n, round(r.score, 9)) for r in x.collect())
    got = key(site_noise.scores(whole, bins=10))
    assert got == key(site_noise.scores(batches, bins=10))
    dist = {s: [0] * 10 for s in {tuple(r[:4]) for r in rows}}
    for *s, _, a, b in rows:
        if a is not None and a + b:
            dist[tuple(s)][int(9 * b / (a + b))] += 1
    share = {s: [v / max(d) for v in d] for s, d in dist.items() if sum(d)}
    var = [np.var([v[k] for v in share.values()]) for k in range(10)]
    least = min(v for v in var if v > 1e-13)
    var = [v if v > 1e-13 else least / (k + 1) for k, v in enumerate(var)]
    own = {s: 10 * math.log(1 + sum(v * v / w for v, w in list(zip(share[s], var))[1:])) if s in share else 0.0 for s in dist}
    want = []
    for s in dist:
        near = [o for o in dist if o[:2] == s[:2]]
        top, first = max(own[o] for o in near), min([o for o in near if len(o[3]) > 1], default=None)
        of, score = (first, own[first]) if len(s[3]) > 1 else (s, own[s] + 0.75 * (top - own[s]))
        want.append((*s, tuple(dist[of]), sum(dist[of]), round(score, 9)))
    assert [g[:6] for g in got] == [w[:6] for w in sorted(want)]
    assert [g[6] for g in got] == pytest.approx([w[6] for w in sorted(want)], rel=1e-7)
    assert site_noise.scores(whole, site_noise.KNOWN, bins=10).agg({"score": "max"}).first()[0] > 50
    assert site_noise.spread([1.0, 0.5, 0.0], 5) == pytest.approx([1, 0.75, 0.5, 0.25, 0])
    assert site_noise.scores(whole.limit(0), bins=10).count() == 0
