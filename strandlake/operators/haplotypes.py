"""Consequences on haplotypes: all variants that a sample carries on one copy of a transcript are spliced in together, so that
neighbouring changes of one codon, and indels that mend each other's frame, are told as the one change they make.

Joins and groupings find, per transcript and copy, the path of variants; equal paths of samples are one row from there on (with the
copies that have it), and paths are grouped by transcript and first variant, since those with different first variants
share no node. Only records are moved, to their transcript's task. Within a group the paths are a prefix tree: a node is a variant in place, shared by
all paths that lead through it; a block of variants is spliced and translated once for its transcript. A row never carries more than the paths of one subtree.

A path is cut into blocks: variants belong to one block while the frame is shifted, or while the next one begins in the codon in
which the last one ends. A block gives one row; where its variants touch the ends of an exon, further rows say so.

Defined results: records that do not change anything, symbolic and `*` alleles are passed over; of overlapping variants on one copy the
first by position stays; missing alleles are taken as reference; variants that reach across the end of a coding part are not spliced, but
reported as splice_acceptor, splice_donor, splice_region or coding_sequence; transcripts without coding parts, and contigs without
sequence, give nothing; repeated records are one; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.consequence import AMINO_ACIDS, BASES, coding_sequences
from strandlake.operators.regions import levels_in, overlap_join, parts_of

# Fixed value: names of consequences in the order in which those of one block are joined.
ORDER = ("synonymous", "missense", "stop_lost", "stop_gained", "inframe_deletion", "inframe_insertion", "frameshift", "splice_acceptor", "splice_donor", "start_lost", "splice_region", "stop_retained", "coding_sequence", "inframe_altering", "start_retained")
DONOR, REGION_INTRON, REGION_EXON = 2, 8, 3  # bases of an intron's ends, and of the exon's next to it
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")
SLICE = 32  # groups of paths that are Python objects at one time
FIELDS = ("pos", "type", "aa", "dna", "stop_before", "n_variants")
ROWS = pa.list_(pa.struct(list(zip(FIELDS, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()]))))


class Node(NamedTuple):
    """A variant in place, in the direction of the transcript: where its REF begins in the coding sequence, REF's length, ALT, what
    is changed in REF (from, to), and its text."""

    at: int
    ref_len: int
    alt: str
    low: int
    high: int
    pos: int
    text: str
    edges: tuple[str, ...]

    @property
    def grows(self) -> int:
        return len(self.alt) - self.ref_len


class Transcript:
    """Coding parts (beg, end) in order of the genome, the sequence that they make, 5' to 3', and how many bases of it lie before
    the first whole codon."""

    def __init__(self, strand: str, parts: list[tuple[int, int]], cds: str, phase: int):
        self.minus, self.phase, self.cds = strand == "-", phase, cds[phase:].upper()
        self.parts, before = [], 0
        for b, e in parts:
            self.parts.append((b, e, before))
            before += e - b + 1
        self.total = before
        self.starts = phase == 0 and self.cds.startswith("ATG")
        self.stops = len(self.cds) % 3 == 0 and translate(self.cds[-3:]) == "*"
        self.protein = translate(self.cds)
        self.placed, self.told = {}, {}

    def node(self, *variant) -> Node | tuple[str, ...]:
        """What place says of a variant, found once for all paths of the transcript."""
        if variant not in self.placed:
            self.placed[variant] = self.place(*variant)
        return self.placed[variant]

    def block(self, nodes: tuple[Node, ...], shift: int) -> tuple[list[tuple], bool]:
        """Rows of a block, but for whether the protein has ended before it, and whether it ends it; found once for all paths."""
        if (nodes, shift) not in self.told:
            b, in_order = block_of(self, nodes, shift), sorted(nodes, key=lambda x: x.pos)
            rows = [(in_order[0].pos, "&".join(x for x in ORDER if x in b.types), b.aa, "+".join(x.text for x in in_order), len(nodes))]
            self.told[nodes, shift] = rows + [(x.pos, "&".join(x.edges), None, x.text, 1) for x in nodes if x.edges], b.stops
        return self.told[nodes, shift]

    def place(self, pos: int, ref: str, alt: str) -> Node | tuple[str, ...]:
        """The node of a variant; its splice consequences where it cannot be spliced in; an empty tuple where there is nothing to say."""
        right = 0
        while right < min(len(ref), len(alt)) and ref[-1 - right] == alt[-1 - right]:
            right += 1
        r, a = ref[: len(ref) - right], alt[: len(alt) - right]
        left = 0
        while left < min(len(r), len(a)) and r[left] == a[left]:
            left += 1
        low, r, a = pos + left, r[left:], a[left:]
        if not r and not a:
            return ()
        high = low + len(r) - 1  # of an insertion: the base before it
        edges, touched, home = set(), False, None
        for n, (beg, end, before) in enumerate(self.parts):
            if high < beg - REGION_INTRON or low > end + REGION_INTRON:
                continue
            edges |= self.edges(low, high, beg, end, n, bool(r))
            if (beg <= low and high <= end) if r else (beg < low <= end):
                home = beg, end, before
            touched |= bool(r) and low <= end and high >= beg
        told = tuple(x for x in ORDER if x in edges)
        if home is None:
            return told or (("coding_sequence",) if touched else ())
        beg, end, before = home
        at, changed = before + low - beg, (before + low - beg, before + high - beg + 1)
        if (not r or not a) and low > beg and left:  # the base before an indel goes with it, or else the one after it
            at, r, a = at - 1, ref[left - 1] + r, ref[left - 1] + a
        elif (not r or not a) and high < end and right:
            r, a = r + ref[-right], a + ref[-right]
        if self.minus:
            at, a = self.total - at - len(r), a[::-1].translate(COMPLEMENT)
            changed = (self.total - changed[1], self.total - changed[0])
        at -= self.phase
        return Node(at, len(r), a, changed[0] - self.phase, changed[1] - self.phase, pos, f"{pos}{ref}>{alt}", told) if at >= 0 else ()

    def edges(self, low: int, high: int, beg: int, end: int, n: int, replaces: bool) -> set[str]:
        """Splice consequences, by part n, of bases low to high (of an insertion: high is low - 1, and it touches both)."""
        lo, hi = (low, high) if replaces else (high, low)
        found = set()
        for there, near, far, exon in ((n > 0, (beg - DONOR, beg - 1), (beg - REGION_INTRON, beg - DONOR - 1), (beg, beg + REGION_EXON - 1)), (n < len(self.parts) - 1, (end + 1, end + DONOR), (end + DONOR + 1, end + REGION_INTRON), (end - REGION_EXON + 1, end))):
            if not there:
                continue
            meets = lambda span: (lo <= span[1] and hi >= span[0]) if replaces else (span[0] <= lo and hi <= span[1])  # noqa: E731, B023
            if meets(near):
                found.add("splice_acceptor" if (near[1] == beg - 1) != self.minus else "splice_donor")
            if meets(far) or meets(exon):
                found.add("splice_region")
        return found


def translate(bases: str) -> str:
    """Amino acids of the whole codons; X for what is no codon of ACGT."""
    return "".join(CODONS.get(bases[i : i + 3], "X") for i in range(0, len(bases) - 2, 3))


def until_stop(aa: str) -> str:
    return aa[: aa.index("*") + 1] if "*" in aa else aa


class Block(NamedTuple):
    types: frozenset
    aa: str | None
    stops: bool


def block_of(t: Transcript, nodes: list[Node], shift: int) -> Block:
    """What the variants of a block do together. shift: bases that those before the block have added, a multiple of three."""
    beg, end = nodes[0].at, nodes[-1].at + nodes[-1].ref_len
    base = beg - beg % 3
    pieces, at = [t.cds[base:beg]], beg
    for v in nodes:
        pieces += [t.cds[at : v.at], v.alt]
        at = v.at + v.ref_len
    new, grows = "".join(pieces), sum(v.grows for v in nodes)
    open_frame = grows % 3 != 0
    new += t.cds[end:] if open_frame else t.cds[end : end + -len(new) % 3]
    old = t.cds[base:] if open_frame else t.cds[base : end + -(end - base) % 3]
    ref, alt = until_stop(translate(old)), until_stop(translate(new))
    if not ref and not alt:  # in what is left after the last whole codon
        return Block(frozenset({"coding_sequence"}), None, False)
    types, at_start = set(), t.starts and min(v.low for v in nodes) < 3
    at_stop = t.stops and max(v.high for v in nodes) > len(t.cds) - 3
    if grows:
        types.add("frameshift" if open_frame else "inframe_insertion" if grows > 0 else "inframe_deletion")
        if alt.endswith("*") and not ref.endswith("*"):
            types.add("stop_gained")
    else:
        if any(v.grows for v in nodes):
            types.add("inframe_altering")
        for x, y in zip(ref, alt):
            if x != y:
                types.add("stop_lost" if x == "*" else "stop_gained" if y == "*" else "missense")
        if ref == alt:
            types.add("synonymous")
    if at_stop and ref.endswith("*"):
        if alt.endswith("*"):
            types = types - {"stop_lost", "synonymous"} | {"stop_retained"}
        else:
            types.add("stop_lost")
    if at_start:
        if alt.startswith("M"):
            types = types | {"start_retained"} if grows else types
        else:
            types.add("start_lost")
    if len(nodes) > 1 and alt.endswith("*") and not ref.endswith("*") and types & {"inframe_deletion", "inframe_insertion", "inframe_altering"}:
        types = types - {"inframe_deletion", "inframe_insertion", "inframe_altering"} | {"frameshift", "stop_gained"}
    text = True
    if {"frameshift", "start_lost"} <= types:
        types, text = types - {"frameshift"}, False
    if types & {"stop_lost", "stop_gained", "stop_retained", "start_lost", "start_retained"}:
        types -= {"missense"}
    first = base // 3 + 1
    aa = f"{first}{ref}" + ("" if ref == alt else f">{first + shift // 3}{alt}")
    return Block(frozenset(types), aa if text else None, alt.endswith("*"))


def ends_in(v: Node, shift: int) -> int:
    """Codon, on the changed copy, of the last base whose neighbours a variant changes."""
    return (v.at + shift + len(v.alt) - 1 + (v.grows < 0)) // 3


class Tree:
    """Paths of one transcript; blocks are looked up by the node they begin after and the node they end with."""

    def __init__(self, t: Transcript):
        self.t, self.children, self.blocks = t, [{}], {}

    def rows(self, path: list[Node]) -> Iterator[tuple]:
        way = [0]
        for v in path:
            kids = self.children[way[-1]]
            if v not in kids:
                kids[v] = len(self.children)
                self.children.append({})
            way.append(kids[v])
        first, shift, before, stopped = 0, 0, 0, False
        for i, v in enumerate(path):
            shift += v.grows
            if i + 1 < len(path) and ((shift - before) % 3 or ends_in(v, shift - v.grows) >= (path[i + 1].at + shift) // 3):
                continue
            key = (way[first], way[i + 1])
            if key not in self.blocks:
                self.blocks[key] = self.t.block(tuple(path[first : i + 1]), before)
            rows, stops = self.blocks[key]
            for pos, kind, aa, dna, n in rows:
                yield pos, kind, aa, dna, stopped, n
            stopped, first, before = stopped or stops, i + 1, shift


def consequences(t: Transcript, tree: Tree, path: list[tuple[int, str, str]]) -> list[tuple]:
    """Rows of one path of (pos, ref, alt), ascending."""
    nodes, out, last = [], [], -1
    for pos, ref, alt in path:
        v = t.node(pos, ref, alt)
        if isinstance(v, Node):
            if pos + len(ref) - 1 <= last or nodes and overlaps(nodes[-1], v):
                continue
            nodes.append(v)
        elif v:
            out.append((pos, "&".join(v), None, f"{pos}{ref}>{alt}", False, 1))
    if nodes:
        out += tree.rows(nodes[::-1] if t.minus else nodes)
    return out


def overlaps(a: Node, b: Node) -> bool:
    return a.at < b.at + b.ref_len and b.at < a.at + a.ref_len


def models(gff: DataFrame, fasta: DataFrame) -> DataFrame:
    """transcript, chrom, strand, parts, cds, phase (bases before the first whole codon), gene and biotype of coding transcripts."""
    coding = gff.filter("type = 'CDS'").select(F.col("parent").alias("transcript"), "strand", "beg", "phase")
    five = F.when(F.col("strand") == "-", -F.col("beg")).otherwise(F.col("beg"))
    phase = coding.groupBy("transcript").agg(F.coalesce(F.min_by(F.coalesce("phase", F.lit(0)), five), F.lit(0)).alias("phase"))
    t = gff.filter("type IN ('mRNA', 'transcript')").select(F.col("id").alias("transcript"), F.col("parent").alias("_gene"), "biotype", F.col("name").alias("_own"))
    g = gff.filter("type = 'gene'").select(F.col("id").alias("_gene"), F.col("name").alias("_name"))
    named = t.join(g, "_gene", "left").select("transcript", "biotype", F.coalesce("_name", "_own", "_gene").alias("gene"))
    return coding_sequences(gff, fasta).join(phase, "transcript").join(named.dropDuplicates(["transcript"]), "transcript", "left")


def copies(samples: Column, phase: str) -> Column:
    """(sample, copy, allele) of the alleles that are not the reference. phase a: as they stand; r: an unphased heterozygous genotype
    is an error; s: it is passed over; m: all of a sample's alleles on one copy (the first that is not the reference); R: both copies have
    the allele that is not the reference, where the other one is."""

    def one(s: Column) -> Column:
        first, second = F.coalesce(F.get(s["gt"], F.lit(0)), F.lit(0)), F.coalesce(F.get(s["gt"], F.lit(1)), F.lit(0))
        two = F.size(s["gt"]) > 1
        loose = two & F.get(s["gt"], F.lit(0)).isNotNull() & F.get(s["gt"], F.lit(1)).isNotNull() & (first != second) & ~F.coalesce(s["phased"], F.lit(False))
        if phase == "m":
            pair = F.array(F.when(first == 0, second).otherwise(first))
        elif phase == "R":
            pair = F.array(F.when(loose & (first == 0), second).otherwise(first), F.when(loose & (second == 0), first).otherwise(second))
        elif phase == "s":
            pair = F.array(F.when(loose, 0).otherwise(first), F.when(loose, 0).otherwise(second))
        elif phase == "r":
            stop = F.raise_error(F.concat(F.lit("unphased heterozygous genotype of "), s["sample"])).cast("int")
            pair = F.array(F.when(loose, stop).otherwise(first), second)
        else:
            pair = F.array(first, second)
        return F.filter(F.transform(pair, lambda a, k: F.struct(s["sample"].alias("sample"), (k + 1).cast("int").alias("copy"), a.cast("int").alias("allele"))), lambda c: c["allele"] > 0)

    return F.flatten(F.transform(samples, one))


def carried(variants: DataFrame, gff: DataFrame, phase: str = "a") -> DataFrame:
    """transcript, sample, copy, path: the variants (pos, ref, alt) near the coding parts of a transcript on each copy, in order. Without
    samples every record is taken to be on one copy."""
    has = "samples" in variants.columns
    at = F.transform("alt", lambda a, k: F.struct(F.lit("").alias("sample"), F.lit(1).alias("copy"), (k + 1).cast("int").alias("allele")))
    v = variants.select("chrom", "pos", "ref", "alt", (copies(F.col("samples"), phase) if has else at).alias("on")).filter(F.size("on") > 0)
    v = v.withColumn("vend", F.col("pos") + F.length("ref"))
    parts = gff.filter("type = 'CDS'").select(F.col("chrom").alias("tchrom"), (F.col("beg") - REGION_INTRON).alias("tbeg"), (F.col("end") + REGION_INTRON).alias("tend"), F.col("parent").alias("transcript"))
    # levels of all records, told without looking at their samples
    levels = levels_in(variants.select("pos", (F.col("pos") + F.length("ref")).alias("vend")), "pos", "vend") | levels_in(parts, "tbeg", "tend")
    met = overlap_join(v, parts, [("chrom", "tchrom")], ("pos", "vend"), ("tbeg", "tend"), levels=levels)
    # records go to their transcript's task before they are told apart by copies; paths are put together and compared there, and never moved
    met = met.select("transcript", "pos", "ref", "alt", "on").repartition(parts_of(variants.sparkSession), "transcript")
    each = met.select("transcript", "pos", F.upper("ref").alias("ref"), "alt", F.explode("on").alias("c")).select("transcript", "c.sample", "c.copy", F.struct("pos", "ref", F.upper(F.get("alt", F.col("c.allele") - 1)).alias("alt")).alias("v"))
    each = each.filter(F.col("v.alt").rlike("^[ACGTN]+$"))
    # a set: a record near two coding parts comes twice
    return each.groupBy("transcript", "sample", "copy").agg(F.array_sort(F.collect_set("v")).alias("path"))


def haplotype_consequences(variants: DataFrame, gff: DataFrame, fasta: DataFrame, phase: str = "a") -> DataFrame:
    """transcript, gene, biotype, strand, sample, copy, pos, type, aa, dna, stop_before, n_variants: a row for each block of each copy.
    aa: amino acids before and after, with the number of the first; dna: the variants of the block; stop_before: a block
    upstream has ended the protein. Types are in order of ORDER, joined by '&'."""
    distinct = carried(variants, gff, phase).groupBy("transcript", "path").agg(F.collect_list(F.struct("sample", "copy")).alias("who"))
    trees = distinct.groupBy("transcript", F.get("path", F.lit(0)).alias("first")).agg(F.collect_list(F.struct("path", "who")).alias("paths"))
    named = models_names(gff).withColumnRenamed("strand", "_strand")
    rows = models(gff, fasta).select("transcript", "strand", "parts", "cds", "phase").join(named, "transcript", "left").join(trees, "transcript")

    def run(batches):
        last = t = None
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                each = b.column("paths").flatten()
                ways, ends = each.field("path").flatten(), np.cumsum(np.append(0, each.field("path").value_lengths())).tolist()
                variants = list(zip(*(ways.field(c).to_pylist() for c in ("pos", "ref", "alt"))))
                of = np.repeat(np.arange(b.num_rows), b.column("paths").value_lengths())
                models = [b.column(c) for c in ("transcript", "strand", "parts", "cds", "phase")]
                found, size, row, tree = [], [0], -1, None
                for n, i in enumerate(of.tolist()):
                    if (name := models[0][i].as_py()) != last:  # a transcript's rows come one after the other
                        strand, parts, cds, at = (c[i].as_py() for c in models[1:])
                        last, t = name, Transcript(strand, [(p["beg"], p["end"]) for p in parts], cds, int(at))
                    if i != row:
                        row, tree = i, Tree(t)
                    found += consequences(t, tree, variants[ends[n] : ends[n + 1]])
                    size.append(len(found))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(FIELDS), ROWS.value_type)]
                told = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(ROWS.value_type)))
                names = [b.column(c).take(pa.array(of)) for c in ("transcript", "gene", "biotype", "_strand")]
                yield pa.RecordBatch.from_arrays([*names, each.field("who"), told], ["transcript", "gene", "biotype", "strand", "who", "rows"])

    rows = rows.select("transcript", "gene", "biotype", "_strand", "strand", "parts", "cds", "phase", "paths").sortWithinPartitions("transcript")
    told = rows.mapInArrow(run, "transcript string, gene string, biotype string, strand string, who array<struct<sample:string,copy:int>>, rows array<struct<pos:bigint,type:string,aa:string,dna:string,stop_before:boolean,n_variants:int>>")
    out = told.select("transcript", "gene", "biotype", "strand", F.explode("who").alias("w"), "rows").select("transcript", "gene", "biotype", "strand", "w.*", F.explode("rows").alias("r"))
    return out.select("transcript", "gene", "biotype", "strand", "sample", "copy", "r.*")


def models_names(gff: DataFrame) -> DataFrame:
    """transcript, gene, biotype, strand."""
    t = gff.filter("type IN ('mRNA', 'transcript')").select(F.col("id").alias("transcript"), F.col("parent").alias("_gene"), "biotype", "strand", F.col("name").alias("_own"))
    g = gff.filter("type = 'gene'").select(F.col("id").alias("_gene"), F.col("name").alias("_name"))
    return t.join(g, "_gene", "left").select("transcript", "biotype", F.coalesce("_name", "_own", "_gene").alias("gene"), "strand").dropDuplicates(["transcript"])


def compound_records(rows: DataFrame) -> DataFrame:
    """transcript, pos, type, aa, dna, copies, samples: the blocks of haplotype_consequences with how many copies and samples have
    them."""
    return rows.groupBy("transcript", "gene", "strand", "pos", "type", "aa", "dna", "stop_before").agg(F.count("*").alias("copies"), F.countDistinct("sample").alias("samples"))
