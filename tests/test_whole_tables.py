"""Queries over whole tables, against brute force on small tables written here."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from math import comb
from statistics import correlation

import pytest

from strandlake import plans
from strandlake.operators import regions, setops, stats

RNG = random.Random(11)


def day(n):
    return datetime(1995, 1, 1) + timedelta(days=n)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of small tables, and the rows of lineitem and orders."""
    d = str(tmp_path_factory.mktemp("small"))
    lines = [dict(l_orderkey=RNG.randrange(60), l_partkey=RNG.choice([1, 2, 3, 61, 62, 63, 65, 70, 900, 902]), l_suppkey=RNG.randrange(40), l_quantity=float(RNG.randint(1, 50)), l_linenumber=i, l_shipdate=day(RNG.randrange(90)), l_extendedprice=RNG.uniform(1000, 99000), l_discount=RNG.randrange(11) / 100, l_returnflag=RNG.choice("ANR")) for i in range(400)]
    orders = [dict(o_orderkey=k, o_orderstatus=RNG.choice("FOP"), o_orderpriority=RNG.choice(["1-URGENT", "2-HIGH"]), o_orderdate=day(RNG.randrange(90))) for k in range(60)]
    lines = [x | {"l_linenumber": x["l_linenumber"] % 7} for x in {(x["l_orderkey"], x["l_linenumber"] % 7): x for x in lines}.values()]
    spark.createDataFrame(lines).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(orders).write.parquet(f"{d}/orders.parquet")
    return d, lines, orders


def test_ld_pairs_all(spark, small):
    d, lines, _ = small
    q = defaultdict(float)
    for x in lines:
        q[x["l_partkey"], x["l_suppkey"] % 20] += x["l_quantity"]
    want, parts = {}, sorted({p for p, _ in q})
    for a in parts:
        for b in parts:
            both = [(q[a, s], q[b, s]) for s in range(20) if (a, s) in q and (b, s) in q]
            if a < b <= a + 3 and len(both) >= 5:
                want[a, b] = (len(both), correlation(*zip(*both)) ** 2)
    got = {(r.x, r.y): (r.n, r.r2) for r in plans.queries()["ld_pairs_all"](spark, d).collect()}
    assert set(got) == set(want) and {(61, 62), (900, 902)} < set(got)
    assert all(got[k] == (n, pytest.approx(r2, abs=1e-6)) for k, (n, r2) in want.items())


def got(spark, d, name, *cols):
    return sorted(tuple(r[c] for c in cols) for r in plans.queries()[name](spark, d).collect())


def test_intervals_of_all_rows(spark, small):
    d, lines, orders = small
    number = lambda t: (t - datetime(1970, 1, 1)).days
    w = [(o["o_orderpriority"], number(o["o_orderdate"]), number(o["o_orderdate"]) + o["o_orderkey"] % 5, o["o_orderkey"]) for o in orders]
    pri = {o["o_orderkey"]: o["o_orderpriority"] for o in orders}
    s = [(pri[x["l_orderkey"]], number(x["l_shipdate"]), number(x["l_shipdate"]) + x["l_linenumber"], x["l_orderkey"], x["l_linenumber"]) for x in lines]
    met = {b[3:]: [a for a in w if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]] for b in s}
    line = {b[3:]: b for b in s}
    assert len(line) == len(s) and any(met.values()) and not all(met.values())
    assert got(spark, d, "interval_overlap_join_all", "o_orderkey", "l_orderkey", "l_linenumber") == sorted((a[3], *k) for k, v in met.items() for a in v)
    assert got(spark, d, "region_include_all", "l_orderkey", "l_linenumber") == sorted(k for k, v in met.items() if v)
    assert got(spark, d, "region_exclude_all", "l_orderkey", "l_linenumber") == sorted(k for k, v in met.items() if not v)
    half = [(a[3], *k) for k, v in met.items() for a in v if min(line[k][2], a[2]) - max(line[k][1], a[1]) + 1 >= 0.5 * (a[2] - a[1] + 1)]
    assert got(spark, d, "annotate_min_overlap_all", "o_orderkey", "l_orderkey", "l_linenumber") == sorted(half)
    sums = {(r.l_orderkey, r.l_linenumber): (r.n, r.first, r.total) for r in plans.queries()["annotate_left_range_all"](spark, d).collect()}
    assert sums == {k: (len(v), min((a[3] for a in v), default=None), sum(a[3] for a in v) if v else None) for k, v in met.items()}
    merged = []
    for p, beg, end, _ in sorted(w):
        if merged and merged[-1][0] == p and beg <= merged[-1][2]:
            merged[-1] = (p, merged[-1][1], max(end, merged[-1][2]), merged[-1][3] + 1)
        else:
            merged.append((p, beg, end, 1))
    assert got(spark, d, "merge_intervals_all", "pri", "beg", "end", "n") == merged
    assert got(spark, d, "gvcf_expand_all", "o_orderkey", "pos") == sorted((a[3], p) for a in w for p in range(a[1], a[2] + 1))


def test_two_sides_of_all_lines(spark, small):
    d, lines, _ = small
    q = defaultdict(lambda: [None, None])
    for x in lines:
        both = q[x["l_partkey"]]
        both[x["l_suppkey"] % 2] = (both[x["l_suppkey"] % 2] or 0) + x["l_quantity"]
    assert got(spark, d, "merge_outer_columns_all", "l_partkey", "q_a", "q_b") == sorted((k, *v) for k, v in q.items())


def test_filter_of_all_orders(spark, small):
    d, lines, _ = small
    unit = lambda x: x["l_extendedprice"] * (1 - x["l_discount"]) / x["l_quantity"]
    want = sorted((x["l_orderkey"], x["l_linenumber"], pytest.approx(unit(x), abs=1e-3), x["l_orderkey"] % 7) for x in lines if unit(x) > 1500)
    assert len({x[3] for x in want}) == 7
    assert [(*r,) for r in got(spark, d, "filter_arithmetic_all", "l_orderkey", "l_linenumber", "unit", "rest")] == want


def test_fisher_of_all_lines(spark, small):
    d, lines, _ = small
    n = lambda flag, low: sum(x["l_returnflag"] == flag and (x["l_discount"] < 0.05) == low for x in lines)
    a, b, c, e = n("A", True), n("A", False), n("R", True), n("R", False)
    ways = [comb(a + b, k) * comb(c + e, a + c - k) for k in range(max(0, a + c - c - e), min(a + b, a + c) + 1)]
    p = sum(w for w in ways if w <= ways[a - max(0, a - e)]) / sum(ways)
    assert got(spark, d, "fisher_2x2", "y", "a", "b", "c", "d", "p") == [(1995, a, b, c, e, pytest.approx(p, abs=6e-7))]


def test_places_of_all_orders(spark, tmp_path):
    orders = [dict(o_orderkey=k, o_orderdate=day(RNG.randrange(20))) for k in RNG.sample(range(1000), 300)]
    spark.createDataFrame(orders).repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted(orders, key=lambda o: (-o["o_orderdate"].toordinal(), o["o_orderkey"]))
    rows = [(r.o_orderkey, r.place) for r in plans.queries()["sort_multi_key_all"](spark, str(tmp_path)).collect()]
    assert rows == [(o["o_orderkey"], i + 1) for i, o in enumerate(want)]


def test_ld_of_parts_without_spread(spark, tmp_path):
    """Quantities that are all the same have no correlation: NaN, as in SQL."""
    q = {7: [4, 4, 4, 4, 4, 4], 8: [1, 2, 3, 4, 5, 6], 9: [2, 2, 2, 2, 2, 2], 11: [3, 1, 2, 6, 5, None]}
    lines = [(p, s, None if v is None else float(v)) for p, vs in q.items() for s, v in enumerate(vs)] + [(12, s, 1.0) for s in range(4)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = {(r.x, r.y): (r.n, r.r2) for r in plans.queries()["ld_pairs"](spark, str(tmp_path)).collect()}
    assert set(rows) == {(7, 8), (7, 9), (8, 9), (8, 11), (9, 11)} and all(n == 6 for n, _ in rows.values())
    assert all((r2 != r2) == (7 in k or 9 in k) for k, (_, r2) in rows.items())
    assert rows[8, 11][1] == pytest.approx(correlation([1, 2, 3, 4, 5], [3, 1, 2, 6, 5]) ** 2, abs=1e-6)


def test_fisher_tests_by_blocks(spark):
    """Blocks of terms in tasks of their own give what one row gives, whatever their size."""
    tables = [(None, 9, 4, 3, 11), ("a", 0, 0, 0, 0), ("b", 0, 5, 7, 0), ("c", 2, 2, 2, 2), ("d", 60, 41, 37, 66), ("e", 700, 640, 655, 690)]
    df = spark.createDataFrame(tables, "y string, a long, b long, c long, d long")
    for block in (1, 7, 1 << 14):
        rows = {r.y: r.p for r in stats.fisher_tests(df, "a", "b", "c", "d", block=block).collect()}
        assert set(rows) == {t[0] for t in tables}
        for y, a, b, c, e in tables:
            lo, hi = max(0, a - e), min(a + b, a + c)
            ways = [comb(a + b, k) * comb(c + e, a + c - k) for k in range(lo, hi + 1)]
            assert rows[y] == pytest.approx(sum(w for w in ways if w <= ways[a - lo]) / sum(ways), rel=1e-9)


def test_fisher_terms_are_rows(spark, small):
    """No row holds all tables with the same margins: terms are not summed within an array."""
    plan = plans.queries()["fisher_2x2"](spark, small[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("Generate explode") == 2


def test_pairs_are_dealt(spark, small):
    """Pairs are many more than rows: the join has the partitions that it is told, whatever Spark thinks of the rows' size."""
    for name in ("interval_overlap_join", "annotate_min_overlap"):
        assert plans.queries()[name](spark, small[0]).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_overlaps_of_mixed_lengths(spark):
    """Every pair once, whatever the lengths are and on either side of zero."""
    some = lambda n: [(i, RNG.choice("pq"), b := RNG.randrange(-3000, 3000), b + RNG.choice([-1, 0, 1, 3, 15, 16, 17, 300, 4000])) for i in range(n)]
    one, two = some(150), some(120)
    a, b = spark.createDataFrame(one, "i long, k string, ab long, ae long"), spark.createDataFrame(two, "j long, kb string, bb long, be long")
    want = sorted((x[0], y[0]) for x in one for y in two if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert len(want) > 400
    for parts in (None, 5):
        join = lambda **o: sorted((r.i, r.j) for r in regions.overlap_join(a, b, [("k", "kb")], ("ab", "ae"), ("bb", "be"), parts=parts, **o).collect())  # noqa: B023, E731
        assert join() == want
        assert join(residual=a["i"] % 3 != b["j"] % 3) == [(i, j) for i, j in want if i % 3 != j % 3]


def test_edit_distances_of_classes(spark, tmp_path):
    def apart(a, b):
        if a is None or b is None:
            return None
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d, old = [i + 1], d
            for j, y in enumerate(b):
                d.append(min(old[j] + (x != y), old[j + 1] + 1, d[j] + 1))
        return d[-1]

    names = [*("".join(RNG.choices("abc", k=RNG.randrange(6))) for _ in range(25)), None]
    parts = [(k, RNG.choice(["B1", "B2", None]), RNG.randrange(2), RNG.choice(names)) for k in range(120)]
    df = spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_name string")
    want = sorted(((a[0], b[0], apart(a[3], b[3])) for a in parts for b in parts if a[0] < b[0] and a[1] and a[1:3] == b[1:3]), key=str)
    for block in (1, 4, 256):
        rows = setops.edit_distances(df, ["p_brand", "p_size"], "p_partkey", "p_name", 5, block)
        assert sorted(((*r,) for r in rows.collect()), key=str) == want
    df.write.parquet(f"{tmp_path}/part.parquet")
    rows = plans.queries()["edit_distance"](spark, str(tmp_path))
    assert sorted(((*r,) for r in rows.collect()), key=str) == want and rows.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
