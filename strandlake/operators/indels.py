"""Calling insertions and deletions by realigning reads.

Candidates are what reads' CIGARs say, in leftmost form, with enough reads behind them. A candidate site's alleles make short haplotypes:
the reference around it with each allele in place. Every read that spans the site is aligned anew to each of them, so reads whose mapper has
smeared an indel into mismatches, or put it elsewhere in a repeat, count for the allele that they fit best.

Equal reads at one place are one row, with how many of them each sample has. Rows meet sites by an interval join and are aligned one by one: no group
of reads is ever held, and a site of any depth is spread over tasks. Within a batch, all pairs of read and haplotype go through one affine-gap alignment at once, an array operation for each base of the
read, in a band around the place where the read was mapped. What a read says of each genotype is added up by Spark.

Defined results: reads that are unmapped, filtered by flag or quality, without sequence, or that do not span a site with a base on either side
say nothing of it; base qualities that are missing count as 30; sites without enough reads are no candidates; contigs without sequence
give nothing; an empty table gives an empty one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.calling import CIGAR
from strandlake.operators.normalise import left_align, reference_text
from strandlake.operators.regions import levels_in, overlap_join, parts_of
from strandlake.session import scratch_path

FLANK, PAD, OPEN, EXTEND = 40, 8, 40.0, 20.0  # bases around a site; width of the band on either side; phred of gaps
LOW = -1e9
TO_LN = -np.log(10) / 10
CODE = np.full(256, 4, np.uint8)
CODE[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3, 0, 1, 2, 3]


def changes(pos: int, cigar: str, seq: str) -> list[tuple[int, int, str]]:
    """(position of the base before, bases deleted, bases inserted) of the indels of a read that have aligned bases on both sides."""
    out, r, q, ops = [], pos, 0, [(int(n), op) for n, op in CIGAR.findall(cigar) if op not in "HP"]
    for k, (n, op) in enumerate(ops):
        if op in "M=X":
            r, q = r + n, q + n
        elif op == "I":
            if 0 < k < len(ops) - 1 and ops[k - 1][1] in "M=X" and ops[k + 1][1] in "M=X":
                out.append((r - 1, 0, seq[q : q + n]))
            q += n
        elif op == "D":
            if 0 < k < len(ops) - 1 and ops[k - 1][1] in "M=X" and ops[k + 1][1] in "M=X":
                out.append((r - 1, n, ""))
            r += n
        elif op == "N":
            r += n
        elif op == "S":
            q += n
    return out


def sound_reads(reads: DataFrame, min_mapq: int, skip_flags: int) -> DataFrame:
    ok = (F.col("flag").bitwiseAND(skip_flags) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "*") & (F.col("seq") != "*")
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))
    return reads.filter(ok).select("chrom", F.coalesce("rg", F.lit("sample")).alias("sample"), F.col("pos").alias("beg"), (F.col("pos") + span - 1).alias("end"), "cigar", "seq", "qual")


def candidates(reads: DataFrame, fasta: DataFrame, min_reads: int = 2, longest: int = 60) -> DataFrame:
    """chrom, pos, ref, alt: sites with the indels, of up to `longest` bases, that at least min_reads reads of one sample have; leftmost, and those of one
    position together. reads: as sound_reads gives them; n, if there, is how many reads a row stands for."""

    def run(batches):
        for b in batches:
            rows = []
            for chrom, sample, pos, cigar, seq, n in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(chrom, sample, *c, n) for c in changes(pos, cigar, seq) if max(c[1], len(c[2])) <= longest]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["chrom", "sample", "pos", "gone", "new", "n"])

    n = F.col("n") if "n" in reads.columns else F.lit(1)
    each = reads.filter(F.col("cigar").rlike("[ID]")).select("chrom", "sample", "beg", "cigar", "seq", n.cast("long").alias("n")).mapInArrow(run, "chrom string, sample string, pos long, gone int, new string, n long")
    counted = each.groupBy("chrom", "sample", "pos", "gone", F.upper("new").alias("new")).agg(F.sum("n").alias("n"))
    path = scratch_path(reads.sparkSession, "indel-counts")  # else reads would be gone through for each of the joins that follow
    counted.write.parquet(path)
    counted = reads.sparkSession.read.schema(counted.schema).parquet(path)
    x = reference_text(counted, fasta, F.col("pos"), F.col("gone") + 1, "ref").filter("length(ref) = gone + 1")
    x = x.withColumn("alt", F.array(F.concat(F.substring("ref", 1, 1), "new")))
    x = left_align(x.select("chrom", "pos", "ref", "alt", "sample", "n"), fasta)
    # reads that had put one indel in several places are counted together now
    x = x.groupBy("chrom", "pos", "ref", F.get("alt", F.lit(0)).alias("alt"), "sample").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_reads)
    x = x.select("chrom", "pos", "ref", "alt").distinct()
    long = F.max(F.struct(F.length("ref"), "ref")).over(Window.partitionBy("chrom", "pos"))["ref"]
    x = x.withColumn("_long", long).withColumn("alt", F.concat("alt", F.substring("_long", F.length("ref") + 1, F.length("_long"))))
    return x.groupBy("chrom", "pos", F.col("_long").alias("ref")).agg(F.array_sort(F.collect_set("alt")).alias("alt"))


def cut_read(beg: int, cigar: str, seq: str, qual: str | None, lo: int, hi: int) -> tuple[int, str, str] | None:
    """(position of the first base, bases, qualities) of a read between the aligned positions lo and hi, without clipped ends."""
    r, q, first, a, b = beg, 0, None, None, None
    for n, op in CIGAR.findall(cigar):
        n = int(n)
        if op in "M=X":
            if first is None and r + n > lo:
                first = max(r, lo)
                a = q + first - r
            if r <= hi:
                b = q + min(n, hi - r + 1)
            r, q = r + n, q + n
        elif op in "DN":
            r += n
        elif op in "IS":
            q += n
    if first is None or b is None or b <= a:
        return None
    known = qual if qual and qual != "*" and len(qual) == len(seq) else "?" * len(seq)
    return first, seq[a:b], known[a:b]


def align(reads: np.ndarray, quals: np.ndarray, size: np.ndarray, haps: np.ndarray, hap_size: np.ndarray, start: np.ndarray, half: int, gap_open: float = OPEN, gap_extend: float = EXTEND) -> np.ndarray:
    """Log likelihood of each read's best alignment to its haplotype. reads, haps: codes by row, padded; start: where in the haplotype the read's
    first base is expected; half: how far a path may leave that diagonal. Ends of the haplotype are free, the read is aligned whole."""
    n, width = len(reads), 2 * half + 1
    rows, band = np.arange(n)[:, None], np.arange(width)[None, :]
    e = np.clip(10.0 ** (-quals / 10.0), 1e-6, 0.75)
    hit, miss = np.log1p(-e), np.log(e / 3)
    first, more = gap_open * TO_LN, gap_extend * TO_LN
    slope = more * np.arange(width)[None, :]
    m = ins = gap = None
    out = np.full(n, LOW)
    for i in range(reads.shape[1]):
        at = start[:, None] + i + band - half
        inside = (at >= 0) & (at < hap_size[:, None])
        base = haps[rows, np.clip(at, 0, haps.shape[1] - 1)]
        emit = np.where((base == reads[:, i : i + 1]) & (base < 4), hit[:, i : i + 1], miss[:, i : i + 1])
        if m is None:
            new, new_ins = np.where(inside, emit, LOW), np.full((n, width), LOW)
        else:
            new = np.where(inside, emit + np.maximum(np.maximum(m, ins), gap), LOW)
            new_ins = np.full((n, width), LOW)  # a base that the haplotype lacks
            new_ins[:, :-1] = np.maximum(m[:, 1:] + first, ins[:, 1:] + more)
        new_gap = np.full((n, width), LOW)  # bases that the read lacks
        new_gap[:, 1:] = np.maximum.accumulate(new - slope, axis=1)[:, :-1] + slope[:, :-1] + first
        m, ins, gap = new, new_ins, np.where(inside, new_gap, LOW)
        done = size == i + 1
        if done.any():
            out[done] = np.maximum(m[done].max(1), ins[done].max(1))
    return out


def padded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(size.max(initial=1))), fill, np.uint8)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("latin-1"), np.uint8)
    return out, size


def read_likelihoods(pairs: list[tuple[str, str, int, str, int]]) -> np.ndarray:
    """Of (bases, qualities, expected start, haplotype, longest change of length): the log likelihoods, in packs of alike width."""
    out = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][4], len(pairs[k][0])))
    for k in range(0, len(order), 2048):
        pack = order[k : k + 2048]
        reads, size = padded([pairs[i][0] for i in pack], 0)
        quals, _ = padded([pairs[i][1] for i in pack], 33)
        haps, hap_size = padded([pairs[i][3] for i in pack], 0)
        out[pack] = align(CODE[reads], quals.astype(float) - 33, size, CODE[haps], hap_size, np.array([pairs[i][2] for i in pack]), PAD + max(pairs[i][4] for i in pack))
    return out


def genotype_terms(log: np.ndarray) -> np.ndarray:
    """What a read says of each diploid genotype, in genotype order, from its log likelihoods by allele; a read cannot say more than that one in a
    million is wrong."""
    log = np.maximum(log - log.max(), -13.8)
    return np.array([np.logaddexp(log[a], log[b]) - np.log(2) for b in range(len(log)) for a in range(b + 1)])


def call_indels(reads: DataFrame, fasta: DataFrame, sites: DataFrame | None = None, min_reads: int = 2, min_mapq: int = 0, skip_flags: int = 0x704, longest: int = 60) -> DataFrame:
    """chrom, pos, ref, alt, samples: indel sites with sample, PL (phred, least 0, in genotype order), gt, AD (reads by the allele that they fit
    best) and DP. sites: (chrom, pos, ref, alt) to call instead of candidates. The genotype is the likeliest one; of equal ones the
    first in order."""
    spark = reads.sparkSession
    sound = sound_reads(reads, min_mapq, skip_flags)
    alike = ["chrom", "beg", "end", "cigar", "seq", "qual"]
    classes = sound.groupBy(*alike, "sample").agg(F.count("*").alias("n")).groupBy(*alike).agg(F.collect_list(F.struct("sample", "n")).alias("who"))
    # reads are gone through once; all that follows reads this table
    path = scratch_path(spark, "indel-classes")
    classes.write.parquet(path)
    classes = spark.read.schema(classes.schema).parquet(path)
    s = candidates(classes.select("*", F.explode("who").alias("w")).select(*alike, "w.*"), fasta, min_reads, longest) if sites is None else sites.select("chrom", "pos", "ref", "alt")
    s = reference_text(s, fasta, F.col("pos") - FLANK, F.lit(FLANK) - F.greatest(F.lit(0), FLANK + 1 - F.col("pos")), "_left")
    s = reference_text(s, fasta, F.col("pos") + F.length("ref"), F.lit(FLANK), "_right")
    s = s.select(F.col("chrom").alias("s_chrom"), F.col("pos").alias("s_pos"), F.col("ref").alias("s_ref"), F.col("alt").alias("s_alt"), F.coalesce("_left", F.lit("")).alias("s_left"), F.coalesce("_right", F.lit("")).alias("s_right"), (F.col("pos") + F.length("ref")).alias("s_end"))
    path = scratch_path(spark, "indel-sites")
    s.write.parquet(path)
    s = spark.read.schema(s.schema).parquet(path)
    levels = levels_in(classes, "beg", "end") | levels_in(s, "s_pos", "s_end")
    met = overlap_join(classes, s, [("chrom", "s_chrom")], ("beg", "end"), ("s_pos", "s_end"), parts=parts_of(spark), levels=levels).filter("beg <= s_pos AND end >= s_end")

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                keep, pairs, spans = [], [], []
                for i, (beg, cigar, seq, qual, pos, ref, alt, left, right) in enumerate(zip(*(b.column(c).to_pylist() for c in ("beg", "cigar", "seq", "qual", "s_pos", "s_ref", "s_alt", "s_left", "s_right")))):
                    part = cut_read(beg, cigar, seq, qual, pos - len(left), pos + len(ref) - 1 + len(right))
                    if part is None:
                        continue
                    wide = max(abs(len(a) - len(ref)) for a in alt)
                    spans.append((len(pairs), len(pairs) + 1 + len(alt)))
                    pairs += [(part[1], part[2], part[0] - (pos - len(left)), left + a + right, wide) for a in (ref, *alt)]
                    keep.append(i)
                log = read_likelihoods(pairs)
                gl = [genotype_terms(log[x:y]).tolist() for x, y in spans]
                best = [int(log[x:y].argmax()) if np.ptp(log[x:y]) > 1 else -1 for x, y in spans]
                b = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("s_chrom"), b.column("s_pos"), b.column("who"), pa.array(gl, pa.list_(pa.float64())), pa.array(best, pa.int32())], ["chrom", "pos", "who", "gl", "best"])

    cols = ("beg", "cigar", "seq", "qual", "who", "s_chrom", "s_pos", "s_ref", "s_alt", "s_left", "s_right")
    told = met.select(*cols).mapInArrow(run, "chrom string, pos long, who array<struct<sample:string,n:bigint>>, gl array<double>, best int")
    told = told.select("chrom", "pos", F.explode("who").alias("w"), "gl", "best").select("chrom", "pos", "w.sample", "w.n", "gl", "best")
    key = ["chrom", "pos", "sample"]
    told_path = scratch_path(spark, "indel-reads")
    told.write.parquet(told_path)
    told = spark.read.schema(told.schema).parquet(told_path)
    # sums by genotype and counts by allele are combined before they are moved
    gl = told.select(*key, "n", F.posexplode("gl").alias("g", "v")).groupBy(*key, "g").agg(F.sum(F.col("v") * F.col("n")).alias("v"))
    gl = gl.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("g", "v"))).alias("_gl"))
    ad = told.groupBy(*key, "best").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("_ad"), F.sum("n").alias("DP"))
    x = gl.join(ad, key).join(s.select(F.col("s_chrom").alias("chrom"), F.col("s_pos").alias("pos"), F.col("s_ref").alias("ref"), F.col("s_alt").alias("alt")), ["chrom", "pos"])
    top = F.array_max("_gl.v")
    pl = F.transform("_gl", lambda g: F.least(F.lit(255), F.round((top - g["v"]) / -TO_LN)).cast("int"))
    x = x.withColumn("PL", pl).withColumn("_k", F.array_position("PL", 0).cast("int") - 1)
    second = F.floor((F.sqrt(8.0 * F.col("_k") + 1) - 1) / 2).cast("int")
    x = x.withColumn("gt", F.array((F.col("_k") - second * (second + 1) / 2).cast("int"), second))
    x = x.withColumn("AD", F.transform(F.sequence(F.lit(0), F.size("alt")), lambda a: F.coalesce(F.try_element_at("_ad", a.cast("int")), F.lit(0)).cast("int")))
    each = F.struct("sample", "PL", "gt", "AD", F.col("DP").cast("int").alias("DP"))
    return x.groupBy("chrom", "pos", "ref", "alt").agg(F.array_sort(F.collect_list(each)).alias("samples"))
