"""Indel calls: planted indels, and the band against a whole alignment."""

import random

import numpy as np
import pytest

from strandlake.operators import indels
from strandlake.operators.calling import read_sam

RNG = random.Random(12)


def whole_alignment(read, qual, hap, gap_open=indels.OPEN, gap_extend=indels.EXTEND):
    """Best alignment of a whole read to any stretch of a haplotype; every cell is filled."""
    first, more, low = gap_open * indels.TO_LN, gap_extend * indels.TO_LN, -1e9
    n = len(hap)
    e = [min(0.75, max(1e-6, 10 ** (-q / 10))) for q in qual]
    prev = None
    for i, c in enumerate(read):
        m, ins, gap = [low] * n, [low] * (n + 1), [low] * n
        for j in range(n):
            emit = np.log1p(-e[i]) if hap[j] == c else np.log(e[i] / 3)
            if prev is None:
                m[j] = emit
            elif j:
                m[j] = emit + max(prev[0][j - 1], prev[1][j - 1], prev[2][j - 1])
            if prev is not None:
                ins[j] = max(prev[0][j] + first, prev[1][j] + more)
            if j:
                gap[j] = max(m[j - 1] + first, gap[j - 1] + more)
        prev = (m, ins, gap)
    return max(max(prev[0]), max(prev[1][:n]))


def test_band_agrees_with_whole():
    pairs, want = [], []
    for _ in range(150):
        hap = "".join(RNG.choice("ACGT") for _ in range(RNG.randint(25, 60)))
        a = RNG.randint(0, 8)
        read = list(hap[a : a + RNG.randint(12, 40)])
        for _ in range(RNG.randint(0, 3)):
            k = RNG.randrange(1, len(read))
            read[k : k + RNG.choice([0, 1, 3])] = [RNG.choice("ACGT") for _ in range(RNG.randint(0, 3))]
        qual = [RNG.randint(5, 40) for _ in read]
        pairs.append(("".join(read), "".join(chr(33 + q) for q in qual), a, hap, 60))  # a band as wide as the haplotype
        want.append(whole_alignment(read, qual, hap))
    assert np.allclose(indels.read_likelihoods(pairs), want)
    near = [(*p[:4], 9) for p in pairs]
    assert np.isclose(indels.read_likelihoods(near), want).mean() > 0.9


def test_changes_and_cuts():
    assert indels.changes(10, "5M2I5M3D4M", "A" * 16) == [(14, 0, "AA"), (19, 3, "")]
    assert indels.changes(10, "3S4M2I", "A" * 9) == [] and indels.changes(10, "2D4M", "AAAA") == []
    assert indels.cut_read(10, "2S3M2I3M", "ttABCxyDEF", "0123456789", 11, 13) == (11, "BCxyD", "34567")
    assert indels.cut_read(10, "3M4D3M", "ABCDEF", None, 12, 18) == (12, "CDE", "???")
    assert indels.cut_read(10, "3M", "ABC", "*", 20, 30) is None


def sam_line(name, pos, cigar, seq, rg):
    return f"{name}\t0\tc\t{pos}\t60\t{cigar}\t*\t0\t0\t{seq}\t{'I' * len(seq)}\tRG:Z:{rg}"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Four sites on a contig; samples with none, one or two copies; some reads have their indel as mismatches or soft clips."""
    ref = "".join(RNG.choice("ACGT") for _ in range(1200))
    ref = ref[:500] + "ACACACACAC" + ref[510:]
    planted = {200: (3, ""), 400: (0, "GATTACA"), 499: (2, ""), 800: (0, ref[800] * 2)}
    truth = {"x": {200: 1, 400: 2, 499: 1, 800: 0}, "y": {200: 0, 400: 1, 499: 2, 800: 1}}
    lines = ["@SQ\tSN:c\tLN:1200"]
    for rg, sites in truth.items():
        for site, copies in sites.items():
            gone, new = planted[site]
            for k in range(40):
                beg = site - RNG.randint(20, 60)
                carries = copies == 2 or copies == 1 and k % 2
                left, right = ref[beg - 1 : site], ref[site + (gone if carries else 0) :]
                seq = (left + (new if carries else "") + right)[:100]
                seq = "".join(RNG.choice("ACGT") if RNG.random() < 0.004 else c for c in seq)
                rest = 100 - len(left) - (len(new) if carries else 0)
                cigar = f"{len(left)}M{gone}D{rest}M" if carries and gone else f"{len(left)}M{len(new)}I{rest}M" if carries else "100M"
                if carries and k % 10 == 1:
                    cigar = "100M"
                lines.append(sam_line(f"{rg}{site}-{k}", beg, cigar, seq, rg))
    path = tmp_path_factory.mktemp("sam") / "reads.sam"
    path.write_text("\n".join(lines) + "\n")
    return read_sam(spark, str(path)), spark.createDataFrame([("c", ref)], "chrom string, seq string"), ref, planted, truth


def test_planted(spark, fixture):
    reads, fasta, ref, planted, truth = fixture
    got = indels.call_indels(reads, fasta, min_reads=4).collect()
    assert len(got) == 4
    for site, (gone, new) in planted.items():
        want = ref[: site] + new + ref[site + gone :]
        (r,) = [r for r in got if abs(r["pos"] - site) < 30]
        assert ref[r["pos"] - 1 :].startswith(r["ref"]) and ref[: r["pos"] - 1] + r["alt"][0] + ref[r["pos"] - 1 + len(r["ref"]) :] == want
        assert r["pos"] == 1 or ref[r["pos"] - 1] == r["alt"][0][0] and (len(r["ref"]) == 1 or r["ref"][-1] != r["alt"][0][-1])
        for s in r["samples"]:
            copies = truth[s["sample"]][site]
            assert sorted(s["gt"]) == [[0, 0], [0, 1], [1, 1]][copies] and len(s["PL"]) == 3 and min(s["PL"]) == 0
            assert s["DP"] == 40 and abs(s["AD"][1] - 20 * copies) <= 4
    deep = reads.unionByName(reads).unionByName(reads)
    assert indels.call_indels(deep, fasta, min_reads=4).filter("samples[0].DP = 120").count() == 4


def test_given_sites_and_nothing(spark, fixture):
    reads, fasta, ref, _, truth = fixture
    sites = spark.createDataFrame([("c", 200, ref[199:203], [ref[199], ref[199:203] + "G"]), ("c", 1000, ref[999], [ref[999] + "T"])], "chrom string, pos long, ref string, alt array<string>")
    (r,) = indels.call_indels(reads, fasta, sites).collect()  # no read spans the other
    assert r["pos"] == 200 and {s["sample"]: s["gt"] for s in r["samples"]} == {"x": [0, 1], "y": [0, 0]} and all(len(s["PL"]) == 6 for s in r["samples"])
    assert indels.call_indels(reads.limit(0), fasta).count() == 0
    assert indels.call_indels(reads, fasta.limit(0)).count() == 0


def test_equal_reads_are_aligned_once(spark, tmp_path, monkeypatch):
    """Copies of a read are one row with a count for each sample, and count as often as they come."""
    monkeypatch.setattr(indels, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    text = "".join(random.Random(5).choices("ACGT", k=200))
    fasta = spark.createDataFrame([("c", text)], "chrom string, seq string")
    gone, plain = text[80:100] + text[103:123], text[80:120]
    reads = [("r", 0, "c", 81, 60, "20M3D20M", gone, "*", s) for s, n in (("a", 7), ("b", 30)) for _ in range(n)] + [("r", 0, "c", 81, 60, "40M", plain, "*", "b")] * 30
    df = spark.createDataFrame(reads, "name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual string, rg string")
    (r,) = indels.call_indels(df, fasta).collect()
    assert {s["sample"]: (s["gt"], s["AD"], s["DP"]) for s in r["samples"]} == {"a": ([1, 1], [0, 7], 7), "b": ([0, 1], [30, 30], 60)}
    rows = spark.read.parquet(f"{tmp_path}/indel-reads")
    assert sorted((x["sample"], x["n"]) for x in rows.collect()) == [("a", 7), ("b", 30), ("b", 30)]
