"""The allele-count spectrum against going through all genotypes."""

import itertools
import math

import numpy as np
import pytest

from strandlake.operators import consensus_calling as cc

SCHEMA = "site int, call string, samples array<struct<sample:string,PL:array<int>>>"


def random_sites(rng, n=40):
    rows = []
    for k in range(n):
        samples = []
        for j in range(rng.integers(0, 6)):
            pl = [int(x) for x in rng.integers(0, 60, rng.choice([2, 3, 3, 3]))]
            samples.append((f"s{j}", [pl, None, [*pl[:-1], None], [0, 0, 0]][rng.choice(4, p=[0.8, 0.06, 0.06, 0.08])]))
        rows.append((k, "clash", samples))
    return rows


def usable(samples):
    return [(n, [10 ** (-(x - min(p)) / 10) for x in p]) for n, p in samples if p is not None and None not in p]


def enumerated(liks, prior):
    """Posterior of the count, over all genotypes; each placement of k copies on the chromosomes is as likely as another."""
    m = sum(len(x) - 1 for x in liks)
    z = np.zeros(m + 1)
    for gts in itertools.product(*(range(len(x)) for x in liks)):
        k = sum(gts)
        z[k] += math.prod(x[g] * math.comb(len(x) - 1, g) for x, g in zip(liks, gts)) / math.comb(m, k)
    return z, z * prior / (z * prior).sum()


def log_likelihood(liks, f):
    return sum(math.log(sum(x[g] * math.comb(len(x) - 1, g) * f**g * (1 - f) ** (len(x) - 1 - g) for g in range(len(x)))) for x in liks)


@pytest.mark.parametrize("kind", cc.PRIORS)
def test_enumeration(spark, kind):
    rows = random_sites(np.random.default_rng(7))
    got = {r["site"]: r for r in cc.call_spectrum(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("call", "row"), kind=kind, theta=0.01, rounds=300, group=["s0", "s2"]).collect()}
    assert len(got) == len(rows)
    for k, _, samples in rows:
        call, own = got[k]["call"], usable(samples)
        liks = [x for _, x in own]
        if not liks:
            assert call is None
            continue
        m = sum(len(x) - 1 for x in liks)
        assert cc.prior(m, kind, 0.01).sum() == pytest.approx(1)
        z, post = enumerated(liks, cc.prior(m, kind, 0.01))
        assert call["an"] == m and np.allclose(call["spectrum"], post, atol=1e-12) and z[call["ac"]] == pytest.approx(z.max())
        assert call["p_ref"] == pytest.approx(post[0]) and call["qual"] == pytest.approx(min(999, -10 * math.log10(max(post[0], 1e-100))), rel=1e-6)
        grid = max(log_likelihood(liks, f) for f in np.linspace(1e-9, 1 - 1e-9, 2001))
        assert log_likelihood(liks, min(max(call["af"], 1e-12), 1 - 1e-12)) >= grid - 1e-3
        one = max(log_likelihood(x, f) for x in [liks] for f in np.linspace(1e-9, 1 - 1e-9, 2001))
        two = sum(max(log_likelihood(x, f) for f in np.linspace(1e-9, 1 - 1e-9, 2001)) for x in ([x for n, x in own if n in ("s0", "s2")], [x for n, x in own if n not in ("s0", "s2")]) if x)
        assert call["lrt"] == pytest.approx(max(0, 2 * (two - one)), abs=5e-3) and call["p_lrt"] == pytest.approx(math.erfc(math.sqrt(call["lrt"] / 2)))
        f, at = call["af"], iter(liks)
        for (_, pl), g, q in zip(samples, call["gt"], call["gq"]):
            if pl is None or None in pl:
                assert (g, q) == (-1, -1)
                continue
            x = next(at)
            p = [x[a] * math.comb(len(x) - 1, a) * f**a * (1 - f) ** (len(x) - 1 - a) for a in range(len(x))]
            assert p[g] == pytest.approx(max(p)) and abs(q - min(99, -10 * math.log10(max(1 - max(p) / sum(p), 1e-10)))) <= 1


def test_many_samples(spark):
    """A thousand samples: nothing vanishes, and planted frequencies are found."""
    rng = np.random.default_rng(5)
    rows = []
    for k, f in enumerate((0.0, 0.02, 0.4)):
        g = rng.binomial(2, f, 1000)
        rows.append((k, "", [(f"s{j}", [abs(x - a) * 25 for a in range(3)]) for j, x in enumerate(g.tolist())]))
    got = {r["site"]: r["call"] for r in cc.call_spectrum(spark.createDataFrame(rows, SCHEMA).drop("call")).collect()}
    assert got[0]["qual"] < 1 and got[1]["qual"] > 100 and got[2]["qual"] == 999
    assert all(abs(got[k]["af"] - f) < 0.03 for k, f in enumerate((0.0, 0.02, 0.4))) and all(abs(got[k]["ac"] - 2000 * got[k]["af"]) <= 20 for k in range(3))


def test_nothing(spark):
    assert cc.call_spectrum(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        cc.prior(4, "guess")
