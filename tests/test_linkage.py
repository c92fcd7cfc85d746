"""Single linkage by a spanning forest against merging the nearest clusters one by one."""

import random

import pytest

from strandlake.operators import sequential

RNG = random.Random(31)


def merged(pairs, limit):
    """Clusters and heights by joining the two nearest clusters until they are further apart than the limit."""
    names = sorted({x for p in pairs for x in p[:2]})
    groups, height = [{n} for n in names], dict.fromkeys(names, 0.0)
    d = {}
    for a, b, v in pairs:
        if v is not None and a != b:
            d[frozenset((a, b))] = min(v, d.get(frozenset((a, b)), float("inf")))
    while True:
        best = min(((min((d.get(frozenset((x, y)), float("inf")) for x in g for y in h), default=float("inf")), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j), default=(float("inf"), 0, 0))
        if best[0] > limit or best[0] == float("inf"):
            return {n: (min(g), height[n]) for g in groups for n in g}
        v, i, j = best
        g = groups[i] | groups[j]
        groups = [x for k, x in enumerate(groups) if k not in (i, j)] + [g]
        height.update(dict.fromkeys(g, v))


@pytest.mark.parametrize("n,share,limit", [(14, 1.0, 30.0), (20, 0.15, 100.0), (12, 1.0, None)])
def test_single_linkage(spark, n, share, limit):
    pairs = [(f"s{i:02d}", f"s{j:02d}", float(RNG.choice([1, 5, 9, 17, 28, 40, 77]))) for i in range(n) for j in range(i) if RNG.random() < share]
    pairs += [("s01", "s00", 33.0), ("s00", "s00", 0.0), ("s02", "s03", None)] + pairs[:3]
    df = spark.createDataFrame(pairs, "p string, q string, v double")
    want = merged(pairs, limit if limit is not None else max(v for *_, v in pairs if v is not None) / 2)
    got = {r["sample"]: (r["cluster"], r["height"]) for r in sequential.cluster_samples(df, "p", "q", "v", threshold=limit).collect()}
    assert got == want


def test_forest(spark):
    """A chain of many nodes, of equal distances, is a tree of all its edges."""
    df = spark.createDataFrame([(i, i + 1, 2.0) for i in range(60)] + [(5, 9, 3.0), (100, 101, 1.0)], "a long, b long, d double")
    got = sequential.spanning_forest(df).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(i, i + 1) for i in range(60)] + [(100, 101)] and len({r["root"] for r in got}) == 2
    assert sequential.spanning_forest(df.limit(0)).count() == 0 and sequential.cluster_samples(df.limit(0), "a", "b", "d").count() == 0
