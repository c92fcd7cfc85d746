"""Consequences on haplotypes of a genome that is made of parts: each part is a codon, sixty in a row are a contig with one transcript; of
twelve codons the last two are an intron. Lines put single bases on copies of ten samples."""

from pyspark.sql import functions as F

from strandlake.operators import haplotypes
from strandlake.operators.consequence import AMINO_ACIDS, BASES
from strandlake.plans import register
from strandlake.session import table

CODON = """SELECT p_partkey, p_partkey // 60 AS contig, CAST(p_partkey % 60 AS INTEGER) AS r, substr('ACGT', CAST(p_size % 4 AS INTEGER) + 1, 1) AS b0, substr('ACGT', CAST((p_size // 4 + p_partkey) % 4 AS INTEGER) + 1, 1) AS b1, substr('ACGT', CAST((p_partkey * 7 + p_size) % 4 AS INTEGER) + 1, 1) AS b2 FROM part"""
_AA = lambda c: f"substr('{AMINO_ACIDS}', 16 * strpos('{BASES}', substr({c}, 1, 1)) + 4 * strpos('{BASES}', substr({c}, 2, 1)) + strpos('{BASES}', substr({c}, 3, 1)) - 20, 1)"

HAPLOTYPES = f"""
WITH codon AS ({CODON}), size AS (SELECT contig, count(*) AS n FROM codon GROUP BY contig),
coding AS (
  SELECT c.*, n, contig % 2 = 1 AS minus, r % 12 < 10 AS inside, r // 12 > 0 AS has_left, n > 12 * (r // 12 + 1) AS has_right, (r // 12) * 10 + r % 12 AS g, (n // 12) * 10 + least(n % 12, 10) AS n_codons FROM codon c JOIN size USING (contig)
), line AS (
  SELECT l_partkey, l_linenumber % 3 AS base, l_suppkey % 10 AS s, CAST(1 + l_orderkey % 2 AS INTEGER) AS copy, max(1 + l_quantity::BIGINT % 3) AS shift FROM lineitem GROUP BY ALL
), v AS (
  SELECT c.*, s, copy, base, 3 * r + base + 1 AS pos, CASE base WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS ref, shift FROM line JOIN coding c ON l_partkey = p_partkey
), w AS (SELECT *, substr('ACGT', CAST((strpos('ACGT', ref) - 1 + shift) % 4 AS INTEGER) + 1, 1) AS alt FROM v),
changed AS (
  SELECT contig, s, copy, p_partkey, minus, g, n_codons, b0 || b1 || b2 AS old,
    coalesce(max(alt) FILTER (WHERE base = 0), b0) || coalesce(max(alt) FILTER (WHERE base = 1), b1) || coalesce(max(alt) FILTER (WHERE base = 2), b2) AS new,
    min(pos) AS pos, string_agg(pos || ref || '>' || alt, '+' ORDER BY pos) AS dna, CAST(count(*) AS INTEGER) AS n_variants
  FROM w WHERE inside GROUP BY contig, s, copy, p_partkey, minus, g, n_codons, b0, b1, b2
), turned AS (
  SELECT * REPLACE (CASE WHEN minus THEN reverse(translate(old, 'ACGT', 'TGCA')) ELSE old END AS old, CASE WHEN minus THEN reverse(translate(new, 'ACGT', 'TGCA')) ELSE new END AS new, CASE WHEN minus THEN n_codons - 1 - g ELSE g END AS g) FROM changed
), ends AS (
  SELECT contig, max(CASE WHEN k = 0 THEN codon END) = 'ATG' AS starts, max(CASE WHEN k = n_codons - 1 THEN {_AA('codon')} END) = '*' AS stops FROM (
    SELECT contig, n_codons, CASE WHEN minus THEN n_codons - 1 - g ELSE g END AS k, CASE WHEN minus THEN reverse(translate(b0 || b1 || b2, 'ACGT', 'TGCA')) ELSE b0 || b1 || b2 END AS codon FROM coding WHERE inside) GROUP BY contig
), aa AS (SELECT t.*, {_AA('old')} AS a, {_AA('new')} AS b, starts AND g = 0 AS at_start, stops AND g = n_codons - 1 AS at_stop FROM turned t JOIN ends USING (contig)),
named AS (
  SELECT *, concat_ws('&', CASE WHEN a = b AND NOT at_stop THEN 'synonymous' END, CASE WHEN a <> b AND a <> '*' AND b <> '*' AND NOT at_start THEN 'missense' END, CASE WHEN a = '*' AND b <> '*' THEN 'stop_lost' END,
      CASE WHEN a <> '*' AND b = '*' THEN 'stop_gained' END, CASE WHEN at_start AND b <> 'M' THEN 'start_lost' END, CASE WHEN at_stop AND b = '*' THEN 'stop_retained' END) AS type,
    (g + 1) || a || CASE WHEN a = b THEN '' ELSE '>' || (g + 1) || b END AS aa,
    coalesce(bool_or(b = '*') OVER (PARTITION BY contig, s, copy ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stop_before
  FROM aa
), rows AS (
  SELECT contig, s, copy, pos, type, aa, dna, stop_before, n_variants FROM named
  UNION ALL SELECT w.contig, w.s, w.copy, w.pos, 'splice_region', NULL, w.pos || ref || '>' || alt, stop_before, 1 FROM w JOIN named USING (contig, s, copy, p_partkey) WHERE r % 12 = 0 AND has_left OR r % 12 = 9 AND has_right
  UNION ALL SELECT contig, s, copy, pos, CASE WHEN (pos - 1) % 36 IN (32, 33) THEN 'splice_region' WHEN ((pos - 1) % 36 < 32) = minus THEN 'splice_acceptor&splice_region' ELSE 'splice_donor&splice_region' END, NULL, pos || ref || '>' || alt, false, 1 FROM w WHERE NOT inside AND has_right
)
"""


def letter(i):
    return F.substr(F.lit("ACGT"), (i % 4).cast("int") + 1, F.lit(1))


def genome(spark, sf):
    """Features and contigs."""
    key, size = F.col("p_partkey"), F.col("p_size")
    codon = table(spark, sf, "part").select(F.concat(F.lit("g"), F.floor(key / 60).cast("string")).alias("chrom"), (F.floor(key / 60) % 2 == 1).alias("minus"), (key % 60).alias("r"), F.concat(letter(size), letter(F.floor(size / 4) + key), letter(key * 7 + size)).alias("codon"))
    fasta = codon.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "codon"))), lambda x: x["codon"]), "").alias("seq"))
    strand = F.when(F.col("minus"), "-").otherwise("+").alias("strand")
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("t"), "chrom")
    whole = codon.groupBy("chrom", "minus").agg((3 * F.max("r") + 3).alias("end")).select("chrom", F.lit("mRNA").alias("type"), F.lit(1).cast("long").alias("beg"), "end", strand, F.lit(None).cast("int").alias("phase"), name.alias("id"), none.alias("parent"), F.lit("protein_coding").alias("biotype"), F.col("chrom").alias("name"))
    part = codon.filter("r % 12 < 10").groupBy("chrom", "minus", F.floor(F.col("r") / 12)).agg((3 * F.min("r") + 1).alias("beg"), (3 * F.max("r") + 3).alias("end"))
    part = part.select("chrom", F.lit("CDS").alias("type"), "beg", "end", strand, F.lit(0).alias("phase"), none.alias("id"), name.alias("parent"), none.alias("biotype"), none.alias("name"))
    return whole.unionByName(part), fasta


def phased(spark, sf):
    """Sites with the copies of ten samples."""
    key = F.col("l_partkey")
    li = table(spark, sf, "lineitem").select(key.alias("k"), (F.col("l_linenumber") % 3).alias("base"), (F.col("l_suppkey") % 10).alias("s"), (1 + F.col("l_orderkey") % 2).alias("copy"), (1 + F.col("l_quantity").cast("long") % 3).alias("shift"))
    on = li.repartition("k").groupBy("k", "base", "s", "copy").agg(F.max("shift").alias("shift"))  # lines are moved once, for all groupings
    two = on.groupBy("k", "base", "s").agg(*(F.coalesce(F.max(F.when(F.col("copy") == c, F.col("shift"))), F.lit(0)).cast("int").alias(f"c{c}") for c in (1, 2)))
    sites = two.groupBy("k", "base").agg(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), F.array("c1", "c2").alias("gt"), F.lit(True).alias("phased"))).alias("samples"))
    p = table(spark, sf, "part")
    x = sites.join(p, F.col("k") == F.col("p_partkey"))
    at = F.when(F.col("base") == 0, F.col("p_size")).when(F.col("base") == 1, F.floor(F.col("p_size") / 4) + F.col("k")).otherwise(F.col("k") * 7 + F.col("p_size"))
    return x.select(F.concat(F.lit("g"), F.floor(F.col("k") / 60).cast("string")).alias("chrom"), (F.col("k") % 60 * 3 + F.col("base") + 1).alias("pos"), letter(at).alias("ref"), F.array(*(letter(at + i) for i in (1, 2, 3))).alias("alt"), "samples")


@register("csq_haplotypes", HAPLOTYPES + "SELECT 'tg' || contig AS transcript, 's' || s AS sample, copy, pos, type, aa, dna, stop_before, n_variants FROM rows")
def csq_haplotypes(spark, sf):
    out = haplotypes.haplotype_consequences(phased(spark, sf), *genome(spark, sf))
    return out.select("transcript", "sample", "copy", "pos", "type", "aa", "dna", "stop_before", "n_variants")


@register("csq_compound", HAPLOTYPES + "SELECT 'tg' || contig AS transcript, pos, type, aa, dna, stop_before, count(*) AS copies, count(DISTINCT s) AS samples FROM rows GROUP BY ALL")
def csq_compound(spark, sf):
    out = haplotypes.compound_records(haplotypes.haplotype_consequences(phased(spark, sf), *genome(spark, sf)))
    return out.select("transcript", "pos", "type", "aa", "dna", "stop_before", "copies", "samples")
