"""Reference blocks of several sources against a walk over every position."""

import random

import pytest

from strandlake.operators import blocks

RNG = random.Random(4)
SCHEMA = "chrom string, pos bigint, end bigint, id array<string>, ref string, alt array<string>, qual double, filters array<string>, samples array<struct<sample:string,gt:array<int>,phased:boolean,DP:int,PL:array<int>>>"


def source(k, chrom="c", length=120):
    """Blocks and variants in turn, with gaps; some variants begin inside a block of their own source."""
    rows, pos = [], RNG.randint(1, 8)
    while pos < length:
        kind, n = RNG.random(), RNG.randint(1, 30)
        dp = RNG.randint(1, 40)
        if kind < 0.6 and n > 1:
            rows.append((chrom, pos, pos + n - 1, [], RNG.choice("ACGT"), RNG.choice([[], ["<*>"]]), None, [], [(f"s{k}", [0, 0], False, dp, [0, 5, 50])]))
            if RNG.random() < 0.2:
                rows.append((chrom, pos + n // 2, None, [], "A", ["G"], 9.0, ["PASS"], [(f"s{k}", [0, 1], True, dp + 1, [9, 0, 80])]))
        elif kind < 0.8:
            rows.append((chrom, pos, None, [], "A", [RNG.choice("CGT")], 5.0, ["PASS"], [(f"s{k}", [1, 1], False, dp, [70, 9, 0])]))
            n = 1
        pos += n + RNG.choice([0, 0, 1, 4])
    return rows


def walked(sources, length=200):
    """(pos, end, {sample: (gt, DP)}) by looking at every position; rows end at breakpoints."""
    marks, out = set(), []
    variant = {}
    for k, rows in enumerate(sources):
        for _, pos, end, _, _, alt, _, _, ss in rows:
            if end is None:
                variant.setdefault(pos, {})[k] = ss
                marks |= {pos, pos + 1}
            else:
                marks |= {pos, end + 1}
    at = {}
    for p in range(1, length):
        at[p] = {k: [r for r in rows if r[2] is not None and r[1] <= p <= r[2]][0][8] for k, rows in enumerate(sources) if any(r[2] is not None and r[1] <= p <= r[2] for r in rows)}
    begin = None
    for p in range(1, length + 1):
        if begin is not None and (p in marks or not at.get(p)):
            out.append((begin, p - 1, cells(at[begin])))
            begin = None
        if p in variant:
            out.append((p, None, cells(at.get(p, {}) | variant[p])))
        elif begin is None and at.get(p):
            begin = p
    return sorted(out, key=repr)


def cells(on):
    return {f"s{k}": (tuple(on[k][0][1]), on[k][0][3]) if k in on else ((None, None), None) for k in range(3)}


@pytest.mark.parametrize("tile", [7, 64, 1 << 20])
def test_walk(spark, tile):
    data = [source(k) for k in range(3)]
    frames = [spark.createDataFrame(d, SCHEMA) for d in data]
    out = blocks.merge_blocks(frames, [["s0"], ["s1"], ["s2"]], spark.createDataFrame([("c", "G" * 200)], "chrom string, seq string"), least="DP", tile=tile, plain=("DP",), by_genotype=("PL",), missing={"PL": "max"}).collect()
    got = sorted(((r["pos"], r["end"], {s["sample"]: (tuple(s["gt"]), s["DP"]) for s in r["samples"]}) for r in out), key=repr)
    want = walked(data)
    place = {p: (sorted({r[5][0] for d in data for r in d if r[1] == p and r[2] is None})) for p, e, _ in want if e is None}
    assert [(p, e) for p, e, _ in got] == [(p, e) for p, e, _ in want]
    for (p, e, a), (_, _, b) in zip(got, want):
        if e is not None or len(place[p]) < 2:  # of several ALTs genotypes are those of the merged order
            assert a == b
    for r in out:
        assert r["DP"] == min(s["DP"] for s in r["samples"] if s["DP"] is not None)
        n = len(r["alt"]) + 1
        begins = {x[4] for d in data for x in d if x[1] == r["pos"] and x[2] is not None}
        if r["end"] is not None:
            assert r["ref"] in (begins or {"G"})
        else:
            assert all(s["PL"] is None or len(s["PL"]) == n * (n + 1) // 2 and None not in s["PL"] for s in r["samples"]) and "<*>" not in r["alt"]


def test_blocks_without_others(spark):
    rows = [("c", 5, 9, [], "A", [], None, [], [("s0", [0, 0], False, 3, None)]), ("d", 5, 9, [], "C", [], None, [], [("s0", [0, 0], False, 4, None)])]
    one, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    out = blocks.merge_blocks([one, none], [["s0"], ["s1"]], plain=("DP",)).collect()
    assert sorted((r["chrom"], r["pos"], r["end"], r["ref"], r["sources"]) for r in out) == [("c", 5, 9, "A", [0]), ("d", 5, 9, "C", [0])]
    assert blocks.merge_blocks([none, none], [["s0"], ["s1"]]).count() == 0
