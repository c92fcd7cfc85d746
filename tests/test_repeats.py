"""Repeat context against a search around each indel."""

import random

from strandlake.operators import repeats

RNG = random.Random(3)
SCHEMA = "chrom string, pos bigint, ref string, alt array<string>, qual double, samples array<struct<sample:string,gt:array<int>>>"


def searched(after, longest=10):
    best = (0, 0)
    for k in range(1, longest + 1):
        if len(after) < k:
            continue
        n = 1
        while after[n * k : n * k + k] == after[:k]:
            n += 1
        best = max(best, (n, k))
    return best


def test_context(spark):
    seq = ""
    while len(seq) < 9000:
        unit = "".join(RNG.choice("ACGT") for _ in range(RNG.randint(1, 12)))
        seq += unit * RNG.randint(1, 6)
    rows = []
    for _ in range(300):
        pos = RNG.randint(1, len(seq) - 12)
        base, n = seq[pos - 1], RNG.randint(1, 9)
        alts = [[base + "ACGTACGTA"[:n]], [RNG.choice("ACGT"), base + "T" * n], ["<DEL>"]][RNG.choice([0, 0, 1, 2])]
        ref = base
        if RNG.random() < 0.5:
            ref, alts = seq[pos - 1 : pos + n], [base]
        rows.append(("c", pos, ref.lower() if RNG.random() < 0.2 else ref, alts, float(RNG.randint(0, 40)), [("s", [RNG.randint(0, 2), 1]), ("t", [0, None])]))
    rows.append(("unknown", 5, "A", ["AC"], 1.0, []))
    df = spark.createDataFrame(rows, SCHEMA)
    out = repeats.repeat_context(df, spark.createDataFrame([("c", seq)], "chrom string, seq string"))
    want = []
    for chrom, pos, ref, alts, qual, _ in rows:
        for k, a in enumerate(alts):
            if not a.startswith("<") and len(a) != len(ref):
                change = len(a) - len(ref)
                n, unit = searched(seq[pos : pos + 50]) if chrom == "c" else (None, None)
                kind = None if n is None else "none" if unit <= 1 or n <= 1 else "whole" if change % unit == 0 else "broken"
                want.append((chrom, pos, k + 1, change, n, unit, kind, qual))
    key = lambda r: tuple(map(str, r))
    got = [(r["chrom"], r["pos"], r["allele"], r["change"], r["copies"], r["unit"], r["context"], r["qual"]) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and {w[6] for w in want} == {None, "none", "whole", "broken"}
    table = {r["unit"]: r for r in repeats.repeat_table(out).collect()}
    for unit, r in table.items():
        mine = [w for w in want if w[6] is not None and (0 if w[6] == "none" else w[5]) == unit]
        assert (r["whole_lost"], r["broken_gained"], r["none"]) == (sum(w[6] == "whole" and w[3] < 0 for w in mine), sum(w[6] == "broken" and w[3] > 0 for w in mine), sum(w[6] == "none" for w in mine))
    grid = repeats.repeat_table(repeats.threshold_grid(out, out["qual"], [20, 0]), "at_least").collect()
    total = lambda rows: sum(r[c] for r in rows for c in ("whole_lost", "broken_lost", "whole_gained", "broken_gained", "none"))
    assert total([r for r in grid if r["at_least"] == 20]) == sum(w[6] is not None and w[7] >= 20 for w in want) and total([r for r in grid if r["at_least"] == 0]) == total(table.values())
    carried = repeats.carriers(out).collect()
    assert {r["sample"] for r in carried} == {"s"} and all(r["copies_carried"] in (1, 2) for r in carried)
    assert set(r["sample"] for r in repeats.repeat_table(repeats.carriers(out), "sample").collect()) == {"s"}
