"""Consequences on haplotypes against sequences that are written out copy by copy."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.operators import consequence, haplotypes
from strandlake.operators.haplotypes import COMPLEMENT, Transcript, Tree, consequences, translate, until_stop

RNG = random.Random(21)
SENSE = [c for c, a in haplotypes.CODONS.items() if a != "*"]


def gene(strand, n_parts=3, stop=True, n=30, phase=0):
    """A contig, the coding parts on it, and their sequence in reading direction."""
    codons = ["ATG"] + [RNG.choice(SENSE) for _ in range(n)] + (["TAA"] if stop else [RNG.choice(SENSE)])
    cds = "".join(RNG.choice("ACGT") for _ in range(phase)) + "".join(codons)
    cuts = sorted(RNG.sample(range(4, len(cds) - 4), n_parts - 1))
    pieces = [cds[a:b] for a, b in zip([0, *cuts], [*cuts, len(cds)])]
    if strand == "-":
        pieces = [p[::-1].translate(COMPLEMENT) for p in pieces[::-1]]
    contig, parts = "".join(RNG.choice("ACGT") for _ in range(15)), []
    for p in pieces:
        parts.append((len(contig) + 1, len(contig) + len(p)))
        contig += p + "".join(RNG.choice("ACGT") for _ in range(20))
    return contig, parts, cds


def variant(contig, lo, hi):
    pos = RNG.randint(lo, hi)
    kind = RNG.choice(["snp"] * 4 + ["mnp", "ins", "del", "complex"])
    n = {"snp": 1, "mnp": RNG.randint(2, 4), "ins": 1, "del": RNG.randint(2, 7), "complex": RNG.randint(2, 4)}[kind]
    ref = contig[pos - 1 : pos - 1 + n]
    some = lambda k: "".join(RNG.choice("ACGT") for _ in range(k))
    alt = {"snp": some(1), "mnp": some(n), "ins": ref + some(RNG.randint(1, 6)), "del": ref[:1], "complex": some(RNG.randint(2, 5))}[kind]
    return pos, ref, alt


def inside(parts, v):
    """Whether all that a variant changes lies in one coding part."""
    pos, ref, alt = v
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    if not ref and not alt:
        return False
    return any(b <= pos and pos + len(ref) - 1 <= e if ref else b < pos <= e for b, e in parts)


def written_out(contig, parts, strand, phase, path):
    """The coding sequence of a copy: every base with what stands in its place."""
    at = {i + 1: c for i, c in enumerate(contig)}
    for pos, ref, alt in path:
        if not inside(parts, (pos, ref, alt)):
            continue
        right = 0
        while right < min(len(ref), len(alt)) and ref[-1 - right] == alt[-1 - right]:
            right += 1
        r, a = ref[: len(ref) - right], alt[: len(alt) - right]
        k = 0
        while k < min(len(r), len(a)) and r[k] == a[k]:
            k += 1
        low, r, a = pos + k, r[k:], a[k:]
        if r:
            for i in range(len(r)):
                at[low + i] = ""
            at[low] = a
        else:
            at[low - 1] += a
    seq = "".join(at[i] for b, e in parts for i in range(b, e + 1))
    return (seq[::-1].translate(COMPLEMENT) if strand == "-" else seq)[phase:]


def rebuilt(protein, rows):
    """The protein with the changes that the rows tell, the last first."""
    told = []
    for r in rows:
        m = re.fullmatch(r"(\d+)([A-Z*]+)(?:>(\d+)([A-Z*]*))?", r[2])
        told.append((int(m[1]), m[2], m[2] if m[3] is None else m[4]))
    for at, old, new in sorted(told, reverse=True):
        assert protein[at - 1 :].startswith(old)
        protein = protein[: at - 1] + new + protein[at - 1 + len(old) :]
    return protein


def apart(path):
    out, last = [], -5
    for v in sorted(path):
        if v[0] > last + 1:
            out.append(v)
            last = v[0] + len(v[1])
    return out


@pytest.mark.parametrize("strand", ["+", "-"])
@pytest.mark.parametrize("phase", [0, 1, 2])
def test_blocks_rebuild_the_protein(strand, phase):
    seen = set()
    for _ in range(150):
        contig, parts, cds = gene(strand, RNG.randint(1, 4), RNG.random() < 0.8, phase=phase)
        t = Transcript(strand, parts, cds, phase)
        tree = Tree(t)
        for _ in range(4):
            path = apart([variant(contig, parts[0][0], parts[-1][1]) for _ in range(RNG.choice([1, 1, 2, 3, 6]))])
            rows = consequences(t, tree, path)
            blocks = [r for r in rows if r[2] is not None]
            types = {x for r in rows for x in r[1].split("&")}
            seen |= types
            new = translate(written_out(contig, parts, strand, phase, path))
            if any(r[5] > 0 and r[2] is None and "start_lost" in r[1] for r in rows):
                assert not new.startswith("M")
                continue
            if phase and strand == "+" and any(v[0] < parts[0][0] + phase + 1 for v in path) or phase and strand == "-" and any(v[0] + len(v[1]) > parts[-1][1] - phase for v in path):
                continue  # before the first whole codon
            assert until_stop(rebuilt(t.protein, blocks)) == until_stop(new)
            first = until_stop(t.protein)
            if until_stop(new) == first:
                assert not types & {"missense", "stop_gained", "frameshift"} or "*" in t.protein[:-1] or any(r[4] for r in rows) or "frameshift" in types
            if phase == 0 and not new.startswith("M") and any(inside(parts, v) for v in path):
                assert "start_lost" in types
    assert {"missense", "synonymous", "frameshift", "inframe_deletion", "inframe_insertion", "stop_gained", "splice_region", "splice_acceptor", "splice_donor", "inframe_altering"} <= seen


@pytest.mark.parametrize(
    "path,want",
    [
        ([(7, "A", "G")], [(7, "missense", "3K>3E", "7A>G", False, 1)]),
        # two changes of one codon are one, two of neighbours are two
        ([(7, "A", "T"), (8, "A", "T"), (9, "A", "T")], [(7, "missense", "3K>3F", "7A>T+8A>T+9A>T", False, 3)]),
        ([(9, "A", "G"), (10, "G", "C")], [(9, "synonymous", "3K", "9A>G", False, 1), (10, "missense", "4E>4Q", "10G>C", False, 1)]),
        ([(7, "AA", "TA"), (9, "AG", "AT")], [(7, "stop_gained", "3K>3*", "7AA>TA", False, 1), (9, "stop_gained", "4E>4*", "9AG>AT", True, 1)]),
        ([(7, "AAA", "TTT")], [(7, "missense", "3K>3F", "7AAA>TTT", False, 1)]),
        ([(9, "AGA", "TCT")], [(9, "missense", "3KE>3NL", "9AGA>TCT", False, 1)]),
        # a shifted frame that is mended
        ([(6, "CA", "C"), (12, "A", "AT")], [(6, "missense&inframe_altering", "2PKE>2PKN", "6CA>C+12A>AT", False, 2)]),
        ([(6, "CA", "C")], [(6, "frameshift", "2PKEWL*>2PKNGC", "6CA>C", False, 1)]),
        ([(6, "CAAA", "C")], [(6, "inframe_deletion", "2PK>2P", "6CAAA>C", False, 1)]),
        ([(6, "C", "CTGA")], [(6, "stop_gained&inframe_insertion", "2P>2P*", "6C>CTGA", False, 1)]),
        ([(2, "T", "C")], [(2, "start_lost", "1M>1T", "2T>C", False, 1)]),
        ([(17, "G", "C")], [(17, "missense", "6L>6P", "17G>C", False, 1)]),
        ([(20, "A", "G")], [(20, "stop_retained", "7*", "20A>G", False, 1)]),
        ([(19, "T", "C")], [(19, "stop_lost", "7*>7Q", "19T>C", False, 1)]),
        ([(7, "A", "A")], []),
        ([(7, "AAA", "G"), (8, "A", "C")], [(7, "frameshift", "3KEWL*>3GMAV", "7AAA>G", False, 1)]),
    ],
)
def test_known(path, want):
    cds = "ATGCCCAAAGAATGGCTGTAA"  # M P K E W L *
    t = Transcript("+", [(1, len(cds))], cds, 0)
    got = consequences(t, Tree(t), path)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [(r[0], r[3], r[4], r[5]) for r in got] == [(r[0], r[3], r[4], r[5]) for r in want]
    assert [r[2] for r in got] == [r[2] for r in want]


def test_shared_nodes():
    """Samples share nodes and translations."""
    contig, parts, cds = gene("+", 1, n=60)
    t = Transcript("+", parts, cds, 0)
    tree, b = Tree(t), parts[0][0]
    swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
    at = [b + 10, b + 40, b + 70]
    vs = [(p, contig[p - 1], swap[contig[p - 1]]) for p in at]
    a = consequences(t, tree, vs[:2])
    size = len(tree.children)
    c = consequences(t, tree, vs)
    assert a == c[:2] and len(tree.children) == size + 1 and len(tree.blocks) == 3


def sample(name, gt, phased=True):
    return {"sample": name, "gt": gt, "phased": phased}


VARIANTS = "chrom string, pos bigint, ref string, alt array<string>, samples array<struct<sample:string,gt:array<int>,phased:boolean>>"
GFF = "chrom string, type string, beg bigint, end bigint, strand string, phase int, id string, parent string, biotype string, name string"


def features(name, strand, parts, chrom="1"):
    lo, hi = parts[0][0], parts[-1][1]
    rows = [(chrom, "gene", lo, hi, strand, None, f"g{name}", None, "protein_coding", f"G{name}"), (chrom, "mRNA", lo, hi, strand, None, name, f"g{name}", "protein_coding", None)]
    return rows + [(chrom, "CDS", b, e, strand, 0, None, name, None, None) for b, e in parts]


@pytest.fixture(scope="module")
def cohort(spark):
    """Two transcripts on the strands of two contigs, and phased copies of nine samples."""
    rows, seqs, gff, genes = [], [], [], {}
    for chrom, strand in (("1", "+"), ("2", "-")):
        contig, parts, cds = gene(strand, 3, n=40)
        genes[f"t{chrom}"] = (contig, parts, cds, strand)
        seqs.append((chrom, contig))
        gff += features(f"t{chrom}", strand, parts, chrom)
        made = {}
        for v in [variant(contig, parts[0][0] - 9, parts[-1][1] + 5) for _ in range(40)]:
            made.setdefault((v[0], v[1]), set()).add(v[2])
        for (pos, ref), alts in sorted(made.items()):
            alts = sorted(alts - {ref}) or ["<DEL>"]
            gts = [[RNG.choice([0, 0, 0, None, *range(1, len(alts) + 1)]) for _ in range(2)] for _ in range(9)]
            rows.append((chrom, pos, ref, alts, [sample(f"s{k}", g, RNG.random() < 0.8) for k, g in enumerate(gts)]))
    rows.append(rows[0])
    return spark.createDataFrame(rows, VARIANTS), spark.createDataFrame(gff, GFF), spark.createDataFrame(seqs, "chrom string, seq string"), rows, genes


def test_cohort(spark, cohort):
    df, gff, fasta, rows, genes = cohort
    got = haplotypes.haplotype_consequences(df, gff, fasta)
    assert got.columns == ["transcript", "gene", "biotype", "strand", "sample", "copy", "pos", "type", "aa", "dna", "stop_before", "n_variants"]
    want = []
    for name, (_, parts, cds, strand) in genes.items():
        for k in range(9):
            for copy in (1, 2):
                path = set()
                for chrom, pos, ref, alts, samples in rows:
                    a = samples[k]["gt"][copy - 1]
                    if "t" + chrom == name and a and alts[a - 1][0] != "<":
                        path.add((pos, ref, alts[a - 1]))
                t = Transcript(strand, parts, cds, 0)
                want += [(name, "G" + name, strand, f"s{k}", copy, *r) for r in consequences(t, Tree(t), sorted(path))]
    rows_of = lambda f: sorted(map(repr, f))
    assert rows_of(want) == rows_of(tuple(r) for r in got.drop("biotype").collect())
    counts = haplotypes.compound_records(got)
    assert counts.agg(F.sum("copies")).first()[0] == len(want)


def test_phase(spark):
    cds = "ATGCCCAAAGAATGGCTGTAA"
    gff, fasta = spark.createDataFrame(features("t", "+", [(1, 21)]), GFF), spark.createDataFrame([("1", cds)], "chrom string, seq string")
    df = spark.createDataFrame([("1", 7, "A", ["T"], [sample("x", [0, 1], False), sample("y", [1, 0])]), ("1", 8, "A", ["T"], [sample("x", [1, 0], False), sample("y", [1, 0])])], VARIANTS)
    dna = lambda phase: sorted((r["sample"], r["copy"], r["dna"], r["aa"]) for r in haplotypes.haplotype_consequences(df, gff, fasta, phase).collect())
    y = [("y", 1, "7A>T+8A>T", "3K>3L")]
    assert dna("a") == [("x", 1, "8A>T", "3K>3I"), ("x", 2, "7A>T", "3K>3*"), *y]
    assert dna("s") == y
    assert dna("m") == [("x", 1, "7A>T+8A>T", "3K>3L"), *y]
    assert dna("R") == [("x", 1, "7A>T+8A>T", "3K>3L"), ("x", 2, "7A>T+8A>T", "3K>3L"), *y]
    with pytest.raises(Exception, match="unphased"):
        dna("r")
    alone = haplotypes.haplotype_consequences(df.drop("samples"), gff, fasta).collect()
    assert [(r["sample"], r["dna"]) for r in alone] == [("", "7A>T+8A>T")]
    assert haplotypes.haplotype_consequences(df.limit(0), gff, fasta).count() == 0


def test_local_substitutions_are_translated(spark):
    cds = "ATGCCCAAAGAATGGCTGTAA"
    gff, fasta = spark.createDataFrame(features("t", "+", [(1, 21)]), GFF), spark.createDataFrame([("1", cds)], "chrom string, seq string")
    df = spark.createDataFrame([("1", 7, "AAA", ["AAG", "TTT", "TAA"]), ("1", 9, "AGA", ["TCT"]), ("1", 1, "ATG", ["ATT"])], "chrom string, pos bigint, ref string, alt array<string>")
    got = {(r["pos"], r["alt"]): (r["consequence"], r["aa"]) for r in consequence.local_consequences(df, gff, fasta).collect()}
    assert got == {(7, "AAG"): ("synonymous", "3K"), (7, "TTT"): ("missense", "3K>3F"), (7, "TAA"): ("stop_gained", "3K>3*"), (9, "TCT"): ("missense", "3KE>3NL"), (1, "ATT"): ("start_lost", "1M>1I")}


def test_paths_are_not_moved(spark):
    """Records are sent to their transcript before they are told apart by copies; paths are neither sent nor joined by."""
    df = spark.createDataFrame([("c", 5, "A", ["C"], [sample("s", [0, 1])])], VARIANTS)
    gff = spark.createDataFrame([("c", "mRNA", 1, 30, "+", None, "t", "g", "protein_coding", None), ("c", "CDS", 1, 30, "+", 0, None, "t", None, None)], GFF)
    fasta = spark.createDataFrame([("c", "ATGAAACCCGGGTTTAAACCCGGGTTTTAA")], "chrom string, seq string")
    got = haplotypes.haplotype_consequences(df, gff, fasta)
    plan = got._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sent and not any("path" in x or "copy" in x for x in sent)
    assert [(r["sample"], r["copy"], r["pos"], r["aa"]) for r in got.collect()] == [("s", 2, 5, "2K>2T")]


def test_more_paths_than_a_slice(spark):
    """Rows of a batch are told apart where a slice ends within it."""
    some = [(f"c{k}", 4 + j % 20, "A", ["C"], [sample(f"s{j}", [1, 0]), sample("x", [0, 1])]) for k in range(3) for j in range(60)]
    df = spark.createDataFrame(some, VARIANTS)
    gff = spark.createDataFrame([x for k in range(3) for x in ((f"c{k}", "mRNA", 1, 30, "+", None, f"t{k}", f"g{k}", "protein_coding", None), (f"c{k}", "CDS", 1, 30, "+", 0, None, f"t{k}", None, None))], GFF)
    fasta = spark.createDataFrame([(f"c{k}", "ATG" + "A" * 27) for k in range(3)], "chrom string, seq string")
    rows = haplotypes.haplotype_consequences(df.coalesce(1), gff, fasta).collect()
    want = {(f"t{k}", f"s{j}", 1, 4 + j % 20) for k in range(3) for j in range(60)}
    assert {(r["transcript"], r["sample"], r["copy"], r["pos"]) for r in rows if r["sample"] != "x"} == want and len([r for r in rows if r["sample"] != "x"]) == 180
    assert {(r["transcript"], r["copy"]) for r in rows if r["sample"] == "x"} == {(f"t{k}", 2) for k in range(3)}
    assert all(sum(r["n_variants"] for r in rows if r["sample"] == "x" and r["transcript"] == f"t{k}") == 20 for k in range(3))
