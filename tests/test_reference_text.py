"""The reference as tiles: texts of any length, contigs cut in one pass, FASTA read by lines."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandlake.operators import normalise
from strandlake.sources.text_formats import read_fasta_tiles, tiled, tiles

RNG = random.Random(8)
SEQS = {"1": "".join(RNG.choice("ACGT") for _ in range(50_000)), "2": "".join(RNG.choice("ACGTN") for _ in range(9_001)), "3": "A"}


@pytest.fixture(scope="module")
def fasta(spark):
    return spark.createDataFrame(list(SEQS.items()), "chrom string, seq string")


@pytest.fixture(scope="module")
def pieces(spark):
    """The same contigs as tiles of another width."""
    rows = [(c, a + 1, s[a : a + 700]) for c, s in SEQS.items() for a in range(0, len(s), 700)]
    return tiled(spark.createDataFrame(rows, "chrom string, pos bigint, text string"), 1000)


def places():
    out = [("1", 1, 50_000), ("1", 1, 5_000), ("1", 4_096, 2), ("1", 4_097, 4_096), ("1", 4_000, 20_000), ("1", 49_990, 50), ("2", 1, 9_001), ("2", 8_999, 4_097), ("3", 1, 1), ("3", 2, 5), ("9", 1, 5), ("1", 12_289, 4_097)]
    return out + [("1", RNG.randint(1, 50_000), RNG.choice([1, 30, 4_096, 4_097, 8_192, 8_193, 15_000])) for _ in range(40)]


@pytest.mark.parametrize("kind", ["cells", "pieces"])
def test_text_of_any_length(spark, fasta, pieces, kind):
    rows = [(k, *p) for k, p in enumerate(places())]
    df = spark.createDataFrame(rows, "k int, chrom string, beg bigint, n int")
    got = {r["k"]: r["t"] for r in normalise.reference_text(df, fasta if kind == "cells" else pieces, F.col("beg"), F.col("n"), "t").collect()}
    assert got == {k: SEQS.get(c, "")[b - 1 : b - 1 + n] or None for k, c, b, n in rows}


def test_long_records(spark, fasta):
    """REF of 5,000 and 20,000 bases across tiles."""
    s = SEQS["1"]
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    rows = [("1", p, s[p - 1 : p - 1 + n], ["A"]) for p, n in ((3_000, 5_000), (7, 20_000), (40_000, 1))]
    bad = [("1", p, r[:-1] + other[r[-1]], a) for _, p, r, a in rows]
    far = [("1", 49_000, s[48_999:] + "A", ["G"])]
    df = spark.createDataFrame([*rows, *bad, *far], "chrom string, pos bigint, ref string, alt array<string>")
    ok = lambda r: r["ref"] == s[r["pos"] - 1 : r["pos"] - 1 + len(r["ref"])]
    told = normalise.check_ref(df, fasta, "w").collect()
    assert len(told) == 7 and all(r["ref_ok"] == ok(r) for r in told) and sum(r["ref_ok"] for r in told) == 3
    assert sorted((r["pos"], len(r["ref"])) for r in normalise.check_ref(df, fasta, "x").collect()) == sorted((p, len(r)) for _, p, r, _ in rows)
    assert all(ok(r) for r in normalise.check_ref(df, fasta, "s").collect())
    assert sorted(len(r["ref"]) for r in normalise.check_ref(df, fasta, "s").collect()) == [1, 1, 1001, 5_000, 5_000, 20_000, 20_000]
    filled = normalise.fill_from_fasta(df, fasta, "aa").collect()
    assert all(r["aa"] == s[r["pos"] - 1 : r["pos"] - 1 + len(r["ref"])] for r in filled)


def test_long_deletions_move(spark):
    """A deletion of two copies of a repeat of 2,600 bases comes to rest at its left end."""
    unit = "".join(RNG.choice("ACGT") for _ in range(2_600))
    seq = "G" * 10 + "T" + unit * 4 + "GGGG"
    first = 11 + 2 * len(unit)
    ref = seq[first - 1 : first + 2 * len(unit)]
    df = spark.createDataFrame([("x", first, ref, [ref[0]])], "chrom string, pos bigint, ref string, alt array<string>")
    got = normalise.left_align(df, spark.createDataFrame([("x", seq)], "chrom string, seq string"), 1000).collect()
    assert [(r["pos"], r["ref"], r["alt"]) for r in got] == [(11, seq[10 : 11 + 2 * len(unit)], ["T"])]


def test_tiles_in_one_pass(spark):
    """Time in proportion to the contig."""
    n = 32 << 20
    df = spark.createDataFrame([("1", "ACGTACGA" * (n // 8))], "chrom string, seq string")
    began = time.time()
    got = tiles(df, 1 << 12).agg(F.count("*"), F.sum(F.length("seq")), F.max("beg"), F.countDistinct("seq")).first()
    assert tuple(got) == (n >> 12, n, n - (1 << 12) + 1, 1) and time.time() - began < 40


def test_fasta_by_lines(spark, tmp_path):
    """Files cut anywhere give the tiles of the whole."""
    text = ""
    for name, s in SEQS.items():
        text += f">{name} some words\n" + "".join(s[a : a + 61].lower() + RNG.choice(["\n", "\r\n", "\n\n"]) for a in range(0, len(s), 61))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">b\nACGT\n>empty\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997", "20000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            out = read_fasta_tiles(spark, str(tmp_path), 1000)
            got = {(r["chrom"], r["beg"]): r["seq"] for r in out.collect()}
            assert got == {(c, a + 1): s[a : a + 1000] for c, s in [*SEQS.items(), ("b", "ACGT")] for a in range(0, len(s), 1000)}
            assert tiles(out, 1000).columns == ["chrom", "tile", "beg", "seq"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tiles(out, 777).filter("chrom = '1' AND tile = 3").first()["seq"] == SEQS["1"][3 * 777 : 4 * 777]
