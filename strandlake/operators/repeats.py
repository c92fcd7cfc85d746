"""Repeat context of insertions and deletions: whether what is gained or lost is a whole number of the tandem repeat that follows.

The bases after the one before an indel are tried with every unit of 1 to `longest` bases: how often the text begins with that unit, one copy after the
other. The unit with the most copies counts, of equal ones the longest. All of it is expressions over the reference joined by tiles; a
copy count is a match of the text against its own beginning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.stats_math import variant_type
from strandlake.operators.normalise import reference_text


def best_unit(text: Column, longest: int = 10) -> Column:
    """(copies, unit): of the repeats with which a text begins, the one with the most copies, of equal ones that with the longest unit."""
    tried = [F.struct(F.floor(F.length(F.regexp_extract(text, f"^(.{{{k}}})\\1*", 0)) / k).cast("int").alias("copies"), F.lit(k).alias("unit")) for k in range(1, longest + 1)]
    return F.array_max(F.filter(F.array(*tried), lambda t: t["copies"] > 0))


def repeat_context(df: DataFrame, fasta: DataFrame, window: int = 50, longest: int = 10) -> DataFrame:
    """A row for each ALT of df that is an insertion or a deletion: df's columns, allele (its number), change (bases gained, negative: lost),
    copies and unit of the repeat that follows, and context: none (a unit of one base, or one copy only), whole or broken (change is, or is not, a
    number of units). Contigs that are not known give null context."""
    x = reference_text(df, fasta, F.col("pos") + 1, F.lit(window), "_after")
    x = x.select(*df.columns, "_after", F.posexplode("alt").alias("_n", "_alt")).filter(variant_type(F.upper("ref"), F.upper("_alt")) == "indel")
    x = x.withColumn("allele", F.col("_n") + 1).withColumn("change", F.length("_alt") - F.length("ref")).withColumn("_unit", best_unit(F.upper("_after"), longest))
    x = x.withColumns({"copies": F.col("_unit.copies"), "unit": F.col("_unit.unit")})
    kind = F.when(F.col("unit").isNull(), None).when((F.col("unit") <= 1) | (F.col("copies") <= 1), "none").when(F.col("change") % F.col("unit") == 0, "whole").otherwise("broken")
    return x.withColumn("context", kind).drop("_after", "_n", "_alt", "_unit")


def repeat_table(context: DataFrame, *by: str) -> DataFrame:
    """unit, whole_lost, broken_lost, whole_gained, broken_gained: how many indels of each kind by the length of the repeat's unit (and by columns of
    `by`, as a sample, a frequency bin or a threshold); unit 0 has those without a repeat in `none`."""
    unit = F.when(F.col("context") == "none", 0).otherwise(F.col("unit")).alias("unit")
    count = lambda kind, sign: F.count_if((F.col("context") == kind) & (F.col("change") < 0 if sign < 0 else F.col("change") > 0))
    return context.filter("context IS NOT NULL").groupBy(*by, unit).agg(count("whole", -1).alias("whole_lost"), count("broken", -1).alias("broken_lost"), count("whole", 1).alias("whole_gained"), count("broken", 1).alias("broken_gained"), F.count_if(F.col("context") == "none").alias("none"))


def carriers(context: DataFrame) -> DataFrame:
    """Rows of a context table by sample that carries the allele: sample and copies_carried besides the columns of the table."""
    each = F.explode(F.filter(F.transform("samples", lambda s: F.struct(s["sample"].alias("sample"), F.size(F.filter(s["gt"], lambda a: a == F.col("allele"))).alias("carried"))), lambda c: c["carried"] > 0))
    return context.withColumn("_c", each).withColumns({"sample": F.col("_c.sample"), "copies_carried": F.col("_c.carried")}).drop("_c", "samples")


def threshold_grid(df: DataFrame, value: Column, thresholds: list[float], name: str = "at_least") -> DataFrame:
    """Rows of df once for each threshold that their value reaches, so that a table by `name` is one over a grid of thresholds."""
    return df.withColumn(name, F.explode(F.filter(F.array(*(F.lit(float(t)) for t in sorted(thresholds))), lambda t: value >= t)))
