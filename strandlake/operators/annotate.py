"""Annotation of variant rows (chrom, pos, id, ref, alt, ..) from tables and from other variant rows, and renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.expr import compile_filter
from strandlake.functions.project import Projector
from strandlake.operators.variants import match_key, transfer


def by_alleles(df: DataFrame, ann: DataFrame, columns: dict[str, str], modes: dict[str, str] | None = None, order: list[str] = (), extra: str | None = None) -> DataFrame:
    """Columns of a table (chrom, pos, ref, alt: one allele or several with commas) carried to the records at the same position with
    the same REF and at least one ALT in common. Of several matching rows the first by `order` counts. columns: new name by
    column of ann; modes: how each is transferred; extra: a further condition, in which the names of ann are bound as
    ann_<name>."""
    a = ann.select(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), F.upper("ref").alias("_ref"), F.split(F.upper(F.col("alt")), ",").alias("_alts"), F.struct(*order, *columns).alias("_place"), *(F.col(c).alias(f"ann_{c}") for c in columns))
    # one row for each allele: the join has only equal keys, so a position with many rows is no product of lists
    a = a.withColumn("_allele", F.explode(F.array_distinct("_alts")))
    x = df.withColumn("_row", F.struct(F.monotonically_increasing_id().alias("_id"), *df.columns)).withColumn("_allele", F.explode_outer(F.array_distinct(F.transform("alt", F.upper))))
    cond = (F.col("chrom") == F.col("_chrom")) & (F.col("pos") == F.col("_pos")) & (F.upper("ref") == F.col("_ref")) & (x["_allele"] == a["_allele"])
    met = x.join(a, cond, "left")
    if extra:
        hit = compile_filter(extra, met).site & F.col("_chrom").isNotNull()
        met = met.withColumn("_place", F.when(hit, F.col("_place")))
    best = F.min("_place").alias("_best")
    out = met.groupBy("_row").agg(best).select("_row.*", "_best")
    for c, name in columns.items():
        out = transfer(out, name, F.col(f"_best.{c}"), (modes or {}).get(name, ""))
    return out.drop("_best", "_id")


def by_record(df: DataFrame, ann: DataFrame, columns: dict[str, str], pairing: str = "some", modes: dict[str, str] | None = None) -> DataFrame:
    """Columns of other variant rows carried to records at the same position that pair with them. pairing: exact (same alleles), some
    (same REF, an ALT in common), snps, indels, both, all (any record there), id. Of several the first by alleles counts."""
    if pairing == "some":
        return by_alleles(df, ann.withColumn("alt", F.array_join("alt", ",")), columns, modes)
    key = match_key({"all": "any", "exact": "none"}.get(pairing, pairing))
    a = ann.select(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), key.alias("_key"), F.struct("ref", "alt", *(c for c in columns if c not in ("ref", "alt"))).alias("_place"))
    a = a.groupBy("_chrom", "_pos", "_key").agg(F.min("_place").alias("_best"))
    x = df.withColumn("_k", key)
    out = x.join(a, (F.col("chrom") == F.col("_chrom")) & (F.col("pos") == F.col("_pos")) & (F.col("_k") == F.col("_key")), "left")
    for c, name in columns.items():
        out = transfer(out, name, F.col(f"_best.{c}"), (modes or {}).get(name, ""))
    return out.drop("_k", "_chrom", "_pos", "_key", "_best")


def set_id(df: DataFrame, fmt: str) -> DataFrame:
    """Identifiers from a format string; "+" before it: only where there is none."""
    new = F.array(Projector(df).compile(fmt.removeprefix("+")))
    return df.withColumn("id", F.when(F.size("id") == 0, new).otherwise(F.col("id")) if fmt[0] == "+" else new)


def rename_values(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Values of a column (contigs, say) by a table (old, new); those without a row stay. Spark decides how to join the table."""
    n = names.groupBy(F.col("old").alias("_old")).agg(F.max("new").alias("_new"))
    return df.join(n, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def rename_fields(df: DataFrame, names: dict[str, str], struct: str | None = None) -> DataFrame:
    """Columns, or fields of a struct column such as info, under new names."""
    if struct is None:
        return df.withColumnsRenamed(names)
    fields = df.schema[struct].dataType.fieldNames()
    return df.withColumn(struct, F.struct(*(F.col(f"{struct}.{f}").alias(names.get(f, f)) for f in fields)))


def rename_samples(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Samples under new names; those without one stay."""
    lookup = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
    return df if lookup is None else df.withColumn("samples", F.transform("samples", lambda s: s.withField("sample", F.coalesce(F.try_element_at(lookup, s["sample"]), s["sample"]))))


def known_frequency(df: DataFrame, af: DataFrame, default: float | None = None) -> DataFrame:
    """Adds af from a table (chrom, pos, ref, alt, af) where REF and all ALTs are just the same (of several such rows the least); else the default."""
    a = af.groupBy(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), F.upper("ref").alias("_ref"), F.upper("alt").alias("_alt")).agg(F.min("af").alias("_af"))
    cond = (F.col("chrom") == F.col("_chrom")) & (F.col("pos") == F.col("_pos")) & (F.upper("ref") == F.col("_ref")) & (F.upper(F.array_join("alt", ",")) == F.col("_alt"))
    return df.join(a, cond, "left").withColumn("af", F.coalesce("_af", F.lit(default))).drop("_chrom", "_pos", "_ref", "_alt", "_af")


def constrained(df: DataFrame, targets: DataFrame, insert_missed: bool = False) -> DataFrame:
    """Records at the sites of targets (chrom, pos, ref, alt), with the targets' alleles as alleles and wanted_index: for each allele of
    the target its place among the record's, -1 where the record lacks it. insert_missed: targets without a record come too, as
    rows with missed = true and nulls."""
    t = targets.select("chrom", "pos", F.concat(F.array("ref"), F.col("alt")).alias("alleles"))
    own = F.concat(F.array("ref"), F.col("alt"))
    met = t.join(df, ["chrom", "pos"], "left" if insert_missed else "inner")
    place = F.transform("alleles", lambda a: (F.coalesce(F.array_position(own, a), F.lit(0)) - 1).cast("int"))
    return met.withColumn("missed", F.col("ref").isNull()).withColumn("wanted_index", F.when(F.col("ref").isNotNull(), place))

