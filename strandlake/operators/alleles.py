"""Allele operators on variant rows: left alignment, splitting, joining, merging of allele lists, atomising.

Rows have chrom, pos, ref and alt (array). What is a pure function of one row is DataFrame work; atomising is Arrow-batched. Left
alignment of tables, which needs the reference, is in `normalise`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.stats_math import variant_type  # noqa: F401


def trim_left_align(pos: int, alleles: list[str], reference: str, first: int = 1) -> tuple[int, list[str]]:
    """Leftmost, shortest form of a variant. reference begins at position `first`; symbolic alleles stay as they are."""
    if len(alleles) < 2 or any(not a or not a.isalpha() for a in alleles):
        return pos, alleles
    a = [x.upper() for x in alleles]
    if len(set(a)) == 1:
        return pos, alleles
    while True:
        if len({x[-1] for x in a}) == 1 and (min(map(len, a)) > 1 or pos > first):
            a = [x[:-1] for x in a]
            if any(not x for x in a):
                pos -= 1
                base = reference[pos - first].upper()
                a = [base + x for x in a]
        else:
            break
    while min(map(len, a)) > 1 and len({x[0] for x in a}) == 1:
        a, pos = [x[1:] for x in a], pos + 1
    return pos, a


def split_rows(df: DataFrame, alt: str = "alt", by_alt: tuple[str, ...] = (), by_allele: tuple[str, ...] = (), gt: str | None = None, other: int | None = 0) -> DataFrame:
    """One row per ALT. by_alt: arrays with a value for each ALT; by_allele: those with one for REF too; gt: genotype array
    (this ALT becomes 1, other ALTs `other`)."""
    x = df.select("*", F.posexplode(alt).alias("_k", "_alt"))
    x = x.withColumn(alt, F.array("_alt"))
    for c in by_alt:
        x = x.withColumn(c, F.array(F.get(c, F.col("_k"))))
    for c in by_allele:
        x = x.withColumn(c, F.array(F.get(c, F.lit(0)), F.get(c, F.col("_k") + 1)))
    if gt:
        x = x.withColumn(gt, F.transform(gt, lambda a: F.when(a == F.col("_k") + 1, 1).when(a > 0, F.lit(other)).otherwise(a)))
    return x.withColumn("alt_index", F.col("_k") + 1).drop("_k", "_alt")


def join_rows(df: DataFrame, keys: list[str], alt: str, values: tuple[str, ...] = ()) -> DataFrame:
    """Rows of equal keys as one: ALTs and their values as arrays in the order of the ALTs."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(alt, *values))).alias("_v"))
    return g.select(*keys, F.col(f"_v.{alt}").alias(alt), *(F.col(f"_v.{v}").alias(v) for v in values))


def remap(values: Column, source: Column, target: Column) -> Column:
    """Values that belong to the alleles of source, in the order of target; null for alleles that source lacks."""
    return F.transform(target, lambda a: F.get(values, F.array_position(source, a).cast("int") - 1))


def merge_alleles(ref_a: str, alt_a: list[str], ref_b: str, alt_b: list[str]) -> tuple[str, list[str]]:
    """Union of two allele lists at one position: the shorter REF is extended by the longer's tail, and with it its ALTs."""
    ref = max(ref_a, ref_b, key=len)
    if not (ref.upper().startswith(ref_a.upper()) and ref.upper().startswith(ref_b.upper())):
        raise ValueError("REF alleles do not agree")
    out: list[str] = []
    for own, alts in ((ref_a, alt_a), (ref_b, alt_b)):
        tail = ref[len(own) :]
        for a in alts:
            a = a + tail if a.isalpha() else a
            if a.upper() not in {x.upper() for x in out}:
                out.append(a)
    return ref, out


def atoms(pos: int, ref: str, alt: str) -> list[tuple[int, str, str]]:
    """Single-base changes and one anchored insertion or deletion that make up a change; others come back as they are."""
    if not set((ref + alt).upper()) <= set("ACGTN"):
        return [(pos, ref, alt)]
    while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    n, out = min(len(ref), len(alt)), []
    for i in range(n):
        last = i == n - 1 and len(ref) != len(alt)
        if ref[i] != alt[i]:
            out.append((pos + i, ref[i], alt[i]))
        if last:
            out.append((pos + i, ref[i:], ref[i] + alt[i + 1 :]) if len(alt) > len(ref) else (pos + i, ref[i:], ref[i]))
    return out


def atomize(df: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt (one), from_pos, from_ref, from_alt: the atoms of every ALT."""

    def run(batches):
        for pdf in batches:
            rows = [(c, *x, p, r, a) for c, p, r, alts in zip(pdf["chrom"], pdf["pos"], pdf["ref"], pdf["alt"]) for a in alts for x in atoms(p, r, a)]
            yield pd.DataFrame(rows, columns=["chrom", "pos", "ref", "alt", "from_pos", "from_ref", "from_alt"])

    return df.select("chrom", "pos", "ref", "alt").mapInPandas(run, "chrom string, pos bigint, ref string, alt string, from_pos bigint, from_ref string, from_alt string")


def variant_key(chrom_code: Column, pos: Column, hash31: Column) -> Column:
    """64-bit key: 5 bits of contig, 28 of position, 31 of alleles."""
    return F.shiftleft(chrom_code.cast("long"), 59).bitwiseOR(F.shiftleft(pos.cast("long"), 31)).bitwiseOR(hash31.cast("long"))
