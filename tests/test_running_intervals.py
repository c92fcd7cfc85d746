"""Overlaps by running values against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import regions

RNG = random.Random(17)
A, B = "c string, lo long, hi long, id int", "d string, beg long, fin long, v int"


def intervals(n, keys, width):
    out = []
    for i in range(n):
        lo = RNG.randint(-50, 400)
        out.append((RNG.choice(keys), lo, lo + RNG.choice([0, 1, 5, 30, width]), RNG.choice([None, i % 9, i])))
    return out


def rows(n, keys, width, odd):
    x = [(*r[:3], i) for i, r in enumerate(intervals(n, keys, width))]
    return x + [(keys[0], 9, 3, n), (keys[0], None, 4, n + 1), (keys[0], 4, None, n + 2), (None, 1, 2, n + 3)] if odd else x


@pytest.mark.parametrize("tile", [1, 16, 256, 1 << 20])
def test_running_overlaps(spark, tile):
    a = rows(150, ["x", "y", "z"], 300, True)
    b = [(k, lo, hi, v) for k, lo, hi, v in intervals(120, ["x", "y"], 200)] + [("x", 8, 2, 5), ("x", None, 9, 5), (None, 1, 9, 5), ("x", 3, None, 1)]
    da, db = spark.createDataFrame(a, A), spark.createDataFrame(b, B)
    met = {i: [v for d, beg, fin, v in b if None not in (d, c, beg, fin, lo, hi) and d == c and beg <= fin and lo <= hi and beg <= hi and lo <= fin] for c, lo, hi, i in a}
    keys = [("c", "d")]
    hit = regions.overlaps_any(da, db, keys, ("lo", "hi"), ("beg", "fin"), tile=tile)
    null_keys = {r[3] for r in a if r[0] is None}
    assert hit.columns == ["c", "lo", "hi", "id", "hit"]
    assert {r["id"]: r["hit"] for r in hit.collect() if r["id"] not in null_keys} == {i: bool(m) for i, m in met.items() if i not in null_keys}
    out = regions.overlap_totals(da, db, keys, ("lo", "hi"), ("beg", "fin"), "n", {"total": F.col("v")}, {"least": F.col("v")}, tile)
    got = {r["id"]: (r["n"], r["total"], r["least"]) for r in out.collect() if r["id"] not in null_keys}
    want = {}
    for i, m in met.items():
        known = [v for v in m if v is not None]
        want[i] = (len(m), sum(known) if known else None, min(known, default=None))
    assert got == {i: w for i, w in want.items() if i not in null_keys}


def test_semi_and_anti(spark):
    a = rows(100, ["x", "y"], 50, True)
    b = intervals(40, ["x", "y"], 20)
    da, db = spark.createDataFrame([r for r in a if r[0]], A), spark.createDataFrame(b, B)
    inside = {r[3] for r in a if r[0] and None not in r[1:3] and r[1] <= r[2] and any(k == r[0] and lo <= r[2] and r[1] <= hi for k, lo, hi, _ in b)}
    of = lambda how, **k: sorted(r["id"] for r in regions.overlap_join(da, db, [("c", "d")], ("lo", "hi"), ("beg", "fin"), how, **k).collect())
    assert of("left_semi") == sorted(inside) == of("left_semi", residual=F.lit(True))
    assert of("left_anti") == sorted(r[3] for r in a if r[0] and r[3] not in inside) == of("left_anti", residual=F.lit(True))
    assert regions.overlaps_any(da, db.limit(0), [("c", "d")], ("lo", "hi"), ("beg", "fin")).filter("hit").count() == 0
