"""Consequences: transcript models, local protein consequences, and the splitting of packed consequence strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.normalise import WIDTH
from strandlake.operators.regions import overlap_join
from strandlake.sources.text_formats import tiles

BASES = "TCAG"
# Fixed value: amino acids of the standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT ... GGG.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Fixed value: consequence names in ascending order of severity; names on one line are equal.
SEVERITY = (
    ("intergenic",), ("feature_truncation", "feature_elongation"), ("regulatory",), ("tf_binding_site", "tfbs"), ("downstream", "upstream"), ("non_coding",), ("intron",), ("nmd_transcript",),
    ("non_coding_transcript_exon",), ("5_prime_utr", "3_prime_utr"), ("coding_sequence", "mature_mirna"), ("stop_retained", "start_retained", "synonymous"), ("incomplete_terminal_codon",),
    ("splice_region",), ("missense", "inframe", "protein_altering"), ("transcript_amplification",), ("exon_loss",), ("disruptive",), ("start_lost", "stop_lost", "stop_gained", "frameshift"),
    ("splice_acceptor", "splice_donor"), ("transcript_ablation",),
)


def severity(name: Column) -> Column:
    """Rank of a consequence: the greatest of its '&'-joined parts; a part is looked up as it is, then as the first name in the
    scale that it contains; unknown ones rank highest."""

    def one(p: Column) -> Column:
        inside = F.lit(len(SEVERITY))
        for k in range(len(SEVERITY) - 1, -1, -1):
            hit = F.lit(False)
            for n in SEVERITY[k]:
                hit = hit | F.contains(p, F.lit(n))
            inside = F.when(hit, k).otherwise(inside)
        exact = F.create_map(*(F.lit(x) for k, names in enumerate(SEVERITY) for n in names for x in (n, k)))
        return F.coalesce(exact[p], inside)

    return F.array_max(F.transform(F.split(F.lower(name), "&"), one))


def split_packed(df: DataFrame, packed: Column, fields: list[str], per_transcript: bool = False, sep: str = r"\|") -> DataFrame:
    """Fields of "a|b|c,a|b|c" strings: arrays of one value a transcript, or one row a transcript."""
    parts = F.transform(F.split(packed, ","), lambda t: F.split(t, sep))
    x = df.withColumn("_t", parts)
    if per_transcript:
        x = x.withColumn("_t", F.explode_outer("_t"))
        return x.select(*df.columns, *(F.nullif(F.get("_t", F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(fields))).drop("_t")
    field = lambda i: F.transform("_t", lambda t: F.nullif(F.get(t, F.lit(i)), F.lit("")))
    return x.select(*df.columns, *(field(i).alias(f) for i, f in enumerate(fields)))


def select_transcript(df: DataFrame, keys: list[str], consequence: str, how: str = "worst", flag: str | None = None, least: str | None = None) -> DataFrame:
    """Rows of transcripts (in order of `_order`): all; worst (first of greatest severity); or those whose flag is set. least:
    only consequences at least as severe as this one."""
    x = df.withColumn("severity", severity(F.col(consequence)))
    if least:
        x = x.filter(F.col("severity") >= severity(F.lit(least)))
    if how == "worst":
        best = x.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in x.columns if c not in keys]), F.struct(-F.col("severity"), "_order")).alias("_b"))
        return best.select(*keys, "_b.*")
    return x.filter(F.col(flag).isin("YES", "1")) if flag else x


def translate(codon: Column) -> Column:
    """Amino acid of a codon; X for what is not three of ACGT."""
    at = lambda i: F.instr(F.lit(BASES), F.substring(codon, i, 1)) - 1
    ok = codon.rlike("^[ACGT]{3}$")
    return F.when(ok, F.get(F.split(F.lit(",".join(AMINO_ACIDS)), ","), 16 * at(1) + 4 * at(2) + at(3))).otherwise("X")


def translate_all(bases: Column) -> Column:
    """Amino acids of a text of whole codons."""
    n = F.floor(F.length(bases) / 3).cast("int")
    return F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: translate(F.substring(bases, i * 3 + 1, F.lit(3)))), "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def coding_sequences(gff: DataFrame, fasta: DataFrame) -> DataFrame:
    """transcript, chrom, strand, cds (sequence 5' to 3'), parts (beg, end in order of the genome)."""
    # a coding part is read in slices that lie in one tile of the reference each
    c = gff.filter("type = 'CDS'").select(F.col("parent").alias("transcript"), "chrom", "strand", "beg", "end")
    tile = F.explode(F.sequence(F.floor((F.col("beg") - 1) / WIDTH), F.floor((F.col("end") - 1) / WIDTH))).alias("tile")
    each = c.select("*", tile).join(tiles(fasta, WIDTH).withColumnRenamed("beg", "_from"), ["chrom", "tile"])
    lo, hi = F.greatest("beg", "_from"), F.least(F.col("end"), F.col("_from") + WIDTH - 1)
    each = each.withColumn("_s", F.substring("seq", (lo - F.col("_from") + 1).cast("int"), (hi - lo + 1).cast("int")))
    x = each.groupBy("transcript", "chrom", "strand").agg(F.array_sort(F.collect_set(F.struct("beg", "end"))).alias("parts"), F.array_sort(F.collect_list(F.struct("beg", "tile", "_s"))).alias("_p"))
    plus = F.array_join(F.transform("_p", lambda p: p["_s"]), "")
    return x.withColumn("cds", F.when(F.col("strand") == "-", reverse_complement(plus)).otherwise(plus)).drop("_p")


def local_consequences(variants: DataFrame, gff: DataFrame, fasta: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt, transcript, consequence, aa: each ALT by itself against the coding part it falls into (substitutions
    of any length: synonymous, missense, stop_gained, stop_lost, stop_retained, start_lost, by the codons they lie in; indels: frameshift or
    inframe), else splice_donor,
    splice_acceptor or splice_region near a part's ends, intron or UTR inside the transcript, and intergenic outside."""
    v = variants.select("chrom", "pos", "ref", F.explode("alt").alias("alt")).withColumn("vend", F.col("pos") + F.length("ref") - 1)
    t = gff.filter("type IN ('mRNA', 'transcript')").select(F.col("chrom").alias("tchrom"), F.col("beg").alias("tbeg"), F.col("end").alias("tend"), F.col("id").alias("transcript"), "biotype")
    met = overlap_join(v, t, [("chrom", "tchrom")], ("pos", "vend"), ("tbeg", "tend"), "left")
    cds = coding_sequences(gff, fasta).select("transcript", "strand", "cds", "parts")
    x = met.join(cds, "transcript", "left")
    p = F.col("pos")
    inside = F.exists("parts", lambda q: (q["beg"] <= F.col("vend")) & (q["end"] >= p))
    before = F.aggregate(F.filter("parts", lambda q: q["end"] < p), F.lit(0).cast("long"), lambda s, q: s + q["end"] - q["beg"] + 1)
    part = F.get(F.filter("parts", lambda q: (q["beg"] <= p) & (q["end"] >= p)), F.lit(0))
    offset = F.when(F.col("strand") == "-", F.length("cds") - 1 - (before + p - part["beg"])).otherwise(before + p - part["beg"])
    x = x.withColumn("_o", offset.cast("int"))
    k = F.floor(F.col("_o") / 3).cast("int")
    # substitutions: all codons that they lie in, with and without them
    m = F.length("ref")
    low = F.when(F.col("strand") == "-", F.col("_o") - m + 1).otherwise(F.col("_o"))
    k = F.floor(low / 3).cast("int")
    codons = F.substring(F.col("cds"), k * 3 + 1, ((F.floor((low + m - 1) / 3) - k + 1) * 3).cast("int"))
    bases = F.when(F.col("strand") == "-", reverse_complement(F.col("alt"))).otherwise(F.col("alt"))
    new = F.concat(F.substring(codons, F.lit(1), low - k * 3), bases, F.substring(codons, low - k * 3 + m + 1, m + 6))
    a, b = translate_all(codons), translate_all(new)
    same_size = (m == F.length("alt")) & (F.col("pos") >= part["beg"]) & (F.col("vend") <= part["end"])
    star = lambda c: F.contains(c, F.lit("*"))
    substituted = F.when((k == 0) & a.startswith("M") & ~b.startswith("M"), "start_lost").when(a == b, F.when(star(a), "stop_retained").otherwise("synonymous")).when(star(b) & ~star(a), "stop_gained").when(star(a) & ~star(b), "stop_lost").otherwise("missense")
    coding = F.when(same_size, substituted).when((F.length("alt") - m) % 3 == 0, F.when(F.length("alt") > m, "inframe_insertion").when(F.length("alt") < m, "inframe_deletion").otherwise("coding_sequence")).otherwise("frameshift")
    n = F.size("parts")
    first, last = F.get("parts", F.lit(0))["beg"], F.get("parts", n - 1)["end"]
    edge = lambda lo, hi, side: F.exists("parts", lambda q: (F.col("vend") >= (q["end"] + lo if side == "end" else q["beg"] - hi)) & (p <= (q["end"] + hi if side == "end" else q["beg"] - lo)) & ((q["end"] < last) if side == "end" else (q["beg"] > first)))
    plus = F.col("strand") != "-"
    donor = F.when(plus, edge(1, 2, "end")).otherwise(edge(1, 2, "beg"))
    acceptor = F.when(plus, edge(1, 2, "beg")).otherwise(edge(1, 2, "end"))
    region = edge(3, 8, "end") | edge(3, 8, "beg")
    utr = F.when((F.col("vend") < first) == plus, "5_prime_utr").otherwise("3_prime_utr")
    symbolic = ~F.col("alt").rlike("^[ACGTN]+$")
    what = F.when(F.col("transcript").isNull(), "intergenic").when(symbolic, F.lit(None)).when(F.col("parts").isNull(), "non_coding").when(inside & F.col("_o").isNotNull(), coding).when(inside, "coding_sequence").when(donor, "splice_donor").when(acceptor, "splice_acceptor").when(region, "splice_region").when((F.col("vend") < first) | (p > last), utr).otherwise("intron")
    aa = F.when(inside & same_size & F.col("_o").isNotNull(), F.concat((k + 1).cast("string"), a, F.when(a != b, F.concat(F.lit(">"), (k + 1).cast("string"), b)).otherwise("")))
    return x.select("chrom", "pos", "ref", "alt", "transcript", what.alias("consequence"), aa.alias("aa"))
