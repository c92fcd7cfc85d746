"""Merging sources with reference blocks: records that stand for a stretch of positions without a variant.

A block ends wherever any source has something to say: where one of its own blocks begins or ends, and before and after each variant. So all
sources' block ends and variants are the breakpoints of a sweep; between two of them nothing changes, and one merged row has the
samples of every source whose block covers the stretch. No position is ever written out, and no row per position and sample made.

The sweep is a window over events in order: of each source the last block that has begun is carried on. It runs within tiles of positions,
to which blocks are cut beforehand, so that no task holds a contig; rows that were only parted by the edge of a tile are one
again in the end, by the last true breakpoint before them (of which each tile tells its last one).

Variants are merged as records are (see merge.merge_records): a source without a record at the position, but with a block over it, takes part
with the block's samples as a record without ALT, so its genotypes are those of the block and not missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.merge import UNOBSERVED, merge_records
from strandlake.operators.normalise import reference_text
from strandlake.session import scratch_path

TILE = 1 << 20  # positions


def is_block(end: str = "end") -> Column:
    """A record without an ALT that was seen, which reaches beyond its REF."""
    return F.coalesce(F.col(end) > F.col("pos") + F.length("ref") - 1, F.lit(False)) & (F.size(F.filter("alt", lambda a: ~a.isin(*UNOBSERVED))) == 0)


def stretches(blocks: list[DataFrame], cuts: DataFrame, tile: int = TILE) -> DataFrame:
    """chrom, beg, end, on: the stretches between breakpoints that some block covers; on: by source, the struct `row` of its block
    there, or null. blocks: (chrom, beg, end, row) by source; cuts: (chrom, pos), positions that are stretches of their own."""
    n = len(blocks)
    kind = blocks[0].schema["row"].dataType
    span = reduce(DataFrame.unionByName, [b.select("chrom", "beg", "end", F.lit(i).alias("src"), "row") for i, b in enumerate(blocks)])
    ends = span.select("chrom", F.explode(F.array("beg", F.col("end") + 1)).alias("pos")).unionByName(cuts.select("chrom", F.explode(F.array("pos", F.col("pos") + 1)).alias("pos"))).distinct()
    # blocks cut to tiles; an edge between tiles is a breakpoint that is taken back later
    piece = span.withColumn("tile", F.explode(F.sequence(F.floor(F.col("beg") / tile), F.floor(F.col("end") / tile))))
    piece = piece.withColumn("pos", F.greatest("beg", F.col("tile") * tile)).withColumn("until", F.least("end", F.col("tile") * tile + tile - 1))
    state = lambda i: F.when(F.col("src") == i, F.struct("until", "row")).alias(f"s{i}")
    begun = piece.select("chrom", "tile", "pos", F.lit(False).alias("true"), *(state(i) for i in range(n)))
    none = F.lit(None).cast(T.StructType([T.StructField("until", T.LongType()), T.StructField("row", kind)]))
    marks = ends.select("chrom", F.floor(F.col("pos") / tile).alias("tile"), "pos", F.lit(True).alias("true"), *(none.alias(f"s{i}") for i in range(n)))
    # one row a position: of two blocks of a source that begin there, the one that reaches further
    at = begun.unionByName(marks).groupBy("chrom", "tile", "pos").agg(F.max("true").alias("true"), *(F.max_by(f"s{i}", f"s{i}.until").alias(f"s{i}") for i in range(n)))
    order = Window.partitionBy("chrom", "tile").orderBy("pos")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("next", F.coalesce(F.lead("pos").over(order), F.col("tile") * tile + tile))
    at = at.withColumns({f"s{i}": F.last(f"s{i}", True).over(past) for i in range(n)}).withColumn("own", F.max(F.when(F.col("true"), F.col("pos"))).over(past))
    last = ends.groupBy("chrom", F.floor(F.col("pos") / tile).alias("tile")).agg(F.max("pos").alias("mark"))
    tiles = at.select("chrom", "tile").distinct().join(last, ["chrom", "tile"], "left")  # a row a tile
    tiles = tiles.withColumn("before", F.max("mark").over(Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1))).select("chrom", "tile", "before")
    at = at.join(tiles, ["chrom", "tile"]).withColumn("first", F.coalesce("own", "before"))
    on = F.array(*(F.when(F.col(f"s{i}.until") >= F.col("pos"), F.col(f"s{i}.row")) for i in range(n)))
    at = at.withColumn("on", on).filter(F.exists("on", lambda r: r.isNotNull()))
    return at.groupBy("chrom", F.col("first").alias("beg")).agg((F.max("next") - 1).alias("end"), F.first("on").alias("on"))


def merge_blocks(sources: list[DataFrame], samples: list[list[str]], fasta: DataFrame | None = None, least: str | None = None, tile: int = TILE, pairing: str = "both", by_allele: tuple[str, ...] = (), by_genotype: tuple[str, ...] = (), plain: tuple[str, ...] = (), missing: dict[str, str | float] | None = None, unobserved: str = "variants") -> DataFrame:
    """chrom, pos, end, ref, alt, samples, sources and least of sources with blocks: rows (chrom, pos, end, id, ref, alt, qual, filters,
    samples), of which blocks are told by is_block. end is null for variants. REF of a stretch is its first base, from the reference
    where that is given and N otherwise, unless a block begins there. least: a field of samples whose least value in a stretch is kept
    under its name. Missing values by allele and genotype go by `missing` (default: the greatest for by_genotype, 0 for by_allele).

    Where blocks of one source overlap, the one that began last holds; a source's record holds over its own block. Blocks over which no other source
    says anything come out as they are; a source without blocks gives its records. Empty sources give nothing."""
    cols = ["chrom", "pos", "id", "ref", "alt", "qual", "filters", "samples"]
    rule = {c: 0 for c in by_allele} | {c: "max" for c in by_genotype} | (missing or {})
    # sources are read several times below, so they are written once
    typed = [s.withColumns({"pos": F.col("pos").cast("long"), "end": F.col("end").cast("long")}).select("end", *cols, is_block().alias("_block"), F.lit(i).alias("_of")) for i, s in enumerate(sources)]
    kept = _written(reduce(DataFrame.unionByName, typed), "blocks-in")
    blocks = [kept.filter((F.col("_of") == i) & F.col("_block")).select("chrom", F.col("pos").alias("beg"), "end", F.struct(*cols[1:]).alias("row")) for i in range(len(sources))]
    records = [kept.filter((F.col("_of") == i) & ~F.col("_block")) for i in range(len(sources))]
    cuts = reduce(DataFrame.unionByName, [r.select("chrom", "pos") for r in records]).distinct()
    met = stretches(blocks, cuts, tile)
    # blocks at the positions of variants become records of their source there
    held = _written(met.join(cuts.withColumnRenamed("pos", "beg").withColumn("cut", F.lit(True)), ["chrom", "beg"], "left"), "blocks-on")
    over = held.filter("cut").select("chrom", F.col("beg").alias("pos"), "on")
    each = []
    for i, r in enumerate(records):
        from_block = over.select("chrom", "pos", F.col("on")[i].alias("row")).filter("row IS NOT NULL").join(r.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_anti")
        bare = F.filter("row.alt", lambda a: a.isin(*UNOBSERVED))
        each.append(r.select(*cols).unionByName(from_block.select("chrom", "pos", "row.id", F.lit("").alias("ref"), bare.alias("alt"), F.lit(None).cast("double").alias("qual"), F.array().cast("array<string>").alias("filters"), "row.samples")))
    variants = merge_records(each, samples, pairing, by_allele, by_genotype, plain, missing=rule, unobserved=unobserved)
    fields = [f for f in ("gt", "phased", *plain, *by_allele, *by_genotype)]
    plain_rows = held.filter("cut IS NULL")
    none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))
    parts = []
    for i, names in enumerate(samples):
        kind = {f.name: f.dataType for f in sources[i].schema["samples"].dataType.elementType}
        rows = F.col("on")[i]["samples"]

        def one(name, j, rows=rows, kind=kind):
            there = F.get(rows, j)
            s = F.when(there["sample"] == name, there).otherwise(F.get(F.filter(rows, lambda v: v["sample"] == name), F.lit(0)))
            get = lambda f: F.when(s.isNotNull(), s[f]).otherwise(none) if f == "gt" else F.coalesce(s[f], F.lit(False)) if f == "phased" else s[f].cast(kind[f])
            return F.struct(name.alias("sample"), *(get(f).alias(f) for f in fields))

        parts.append(F.transform(F.lit(names), _two(one)))
    begins = F.filter(F.transform("on", lambda r: F.when(r["pos"] == F.col("beg"), F.substring(r["ref"], 1, 1))), lambda b: b.isNotNull())
    alts = F.array_distinct(F.flatten(F.filter(F.transform("on", lambda r: r["alt"]), lambda a: a.isNotNull())))
    present = F.filter(F.transform("on", lambda r, i: F.when(r.isNotNull(), i)), lambda i: i.isNotNull())
    out = plain_rows.select("chrom", F.col("beg").alias("pos"), "end", F.get(begins, F.lit(0)).alias("ref"), alts.alias("alt"), F.concat(*parts).alias("samples"), F.transform(present, lambda i: i.cast("int")).alias("sources"))
    if fasta is not None:
        out = reference_text(out, fasta, F.col("pos"), F.lit(1), "_base").withColumn("ref", F.coalesce("ref", "_base")).drop("_base")
    out = out.withColumn("ref", F.coalesce("ref", F.lit("N")))
    whole = out.unionByName(variants.select("chrom", "pos", F.lit(None).cast("long").alias("end"), "ref", "alt", "samples", "sources"))
    return whole.withColumn(least, F.array_min(F.transform("samples", lambda s: s[least]))) if least else whole


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _two(f):
    """f as a function of just an element and its place."""
    return lambda x, j: f(x, j)
