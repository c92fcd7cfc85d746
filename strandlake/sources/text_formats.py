"""Text formats of variant and interval tables: readers give DataFrames, writers take them.

All parsing is column expressions over ``spark.read.text``; files of any number split as Spark splits text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import scratch_path

# The eight columns of a site.
SITE = ["chrom", "pos", "id", "ref", "alt", "qual", "filters"]
NUMBERS = {"Integer": "bigint", "Float": "double", "String": "string", "Character": "string", "Flag": "boolean"}


class Header:
    """Declarations of a variant file: fields by kind, contigs in order, samples."""

    def __init__(self, lines: list[str]):
        self.lines = [x for x in lines if x.startswith("##")]
        self.fields: dict[str, dict[str, tuple[str, str]]] = {"INFO": {}, "FORMAT": {}}
        self.contigs: list[str] = []
        for x in self.lines:
            m = re.match(r"##(INFO|FORMAT|contig)=<(.*)>$", x)
            if not m:
                continue
            d = dict(re.findall(r'(\w+)=("[^"]*"|[^,]*)', m[2]))
            if m[1] == "contig":
                self.contigs.append(d["ID"])
            else:
                self.fields[m[1]][d["ID"]] = d.get("Number", "1"), d.get("Type", "String")
        columns = next((x for x in lines if x.startswith("#CHROM")), "").split("\t")
        self.samples = columns[9:]

    def type_of(self, kind: str, name: str) -> str:
        number, t = self.fields[kind][name]
        if t == "Flag":
            return "boolean"
        return NUMBERS[t] if number == "1" else f"array<{NUMBERS[t]}>"


def read_header(spark: SparkSession, path: str) -> Header:
    rows = spark.read.text(path).filter(F.col("value").startswith("#")).collect()
    return Header([r[0] for r in rows])


def _typed(text: Column, kind: str) -> Column:
    missing = text.isNull() | (text == ".")
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.when(~missing, F.transform(F.split(text, ","), lambda x: F.when(x != ".", x).cast(inner)))
    return F.when(~missing, text).cast(kind)


def gt_alleles(text: Column) -> Column:
    return F.transform(F.split(text, r"[/|]"), lambda a: F.when(a != ".", a).cast("int"))


def read_vcf(spark: SparkSession, path: str, header: Header | None = None) -> DataFrame:
    """chrom, pos, id (array), ref, alt (array), qual, filters (array), info (struct of the declared fields), info_more (map of those
    that the header does not declare, as text), samples (array of structs: sample, gt, phased, declared FORMAT fields, more: map
    of the others)."""
    h = header or read_header(spark, path)
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    lst = lambda x, sep: F.when(x == ".", F.array().cast("array<string>")).otherwise(F.split(x, sep))
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    info_map = F.str_to_map(at(7), F.lit(";"), F.lit("="))
    info = [(F.map_contains_key(info_map, k) if h.type_of("INFO", k) == "boolean" else _typed(info_map[k], h.type_of("INFO", k))).alias(k) for k in h.fields["INFO"]]
    keys = F.split(at(8), ":")
    fmt = [k for k in h.fields["FORMAT"] if k != "GT"]

    def sample(name: str, i: int) -> Column:
        v = F.split(at(9 + i), ":")
        get = lambda k: F.get(v, F.array_position(keys, k).cast("int") - 1)
        gt = F.when(F.array_contains(keys, "GT"), get("GT"))
        new = F.filter(keys, lambda k: ~k.isin("GT", *fmt))
        more = F.map_from_arrays(new, F.transform(new, lambda k: F.coalesce(F.get(v, (F.array_position(keys, k) - 1).cast("int")), F.lit("."))))
        return F.struct(F.lit(name).alias("sample"), gt_alleles(gt).alias("gt"), F.contains(gt, F.lit("|")).alias("phased"), more.alias("more"), *(_typed(F.when(F.array_contains(keys, k), get(k)), h.type_of("FORMAT", k)).alias(k) for k in fmt))

    return lines.select(
        at(0).alias("chrom"), at(1).cast("long").alias("pos"), lst(at(2), ";").alias("id"), at(3).alias("ref"), lst(at(4), ",").alias("alt"),
        F.when(at(5) != ".", at(5)).cast("double").alias("qual"), lst(at(6), ";").alias("filters"),
        *([F.struct(*info).alias("info")] if info else []), F.when(at(7) != ".", F.map_filter(info_map, lambda k, v: ~k.isin(*h.fields["INFO"]) if h.fields["INFO"] else F.lit(True))).alias("info_more"), *([F.array(*(sample(s, i) for i, s in enumerate(h.samples))).alias("samples")] if h.samples else []),
    )


def _text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.ArrayType):
        return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.coalesce(_number(x, t.elementType), F.lit("."))), ","))
    return _number(c, t)


def _number(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def vcf_lines(df: DataFrame) -> DataFrame:
    """The text lines of variant rows."""
    fields = {f.name: f.dataType for f in df.schema}
    join = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(".")
    out = [F.col("chrom"), F.col("pos").cast("string"), join("id", ";"), F.col("ref"), join("alt", ","), F.coalesce(_number(F.col("qual"), T.DoubleType()), F.lit(".")), join("filters", ";")]
    if "info" in fields:
        parts = [F.when(F.col(f"info.{f.name}"), F.lit(f.name)) if isinstance(f.dataType, T.BooleanType) else F.concat(F.lit(f.name + "="), _text(F.col(f"info.{f.name}"), f.dataType)) for f in fields["info"]]
    else:
        parts = []
    own = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    if "info_more" in fields:
        more = F.transform(F.map_entries("info_more"), lambda e: F.concat(e["key"], F.coalesce(F.concat(F.lit("="), e["value"]), F.lit(""))))
        own = F.concat(own, F.coalesce(more, F.array().cast("array<string>")))
    out.append(F.coalesce(F.nullif(F.array_join(own, ";"), F.lit("")), F.lit(".")))
    if "samples" in fields:
        s = fields["samples"].elementType
        extra = [f for f in s if f.name not in ("sample", "gt", "phased", "more")]
        told = F.lit(":".join(["GT", *(f.name for f in extra)]))
        rest = F.coalesce(F.array_sort(F.map_keys(F.get("samples", F.lit(0))["more"])), F.array().cast("array<string>")) if "more" in s.names else None
        out.append(told if rest is None else F.concat_ws(":", told, F.nullif(F.array_join(rest, ":"), F.lit(""))))
        gt = lambda x: F.coalesce(F.replace(F.array_join(F.transform(x["gt"], lambda a: F.coalesce(a.cast("string"), F.lit("."))), "/"), F.lit("/"), F.when(x["phased"], "|").otherwise("/")), F.lit("."))
        out.append(F.array_join(F.transform("samples", lambda x: F.concat_ws(":", gt(x), *(F.coalesce(_text(x[f.name], f.dataType), F.lit(".")) for f in extra), *([] if rest is None else [F.nullif(F.array_join(F.transform(rest, lambda k: F.coalesce(F.try_element_at(x["more"], k), F.lit("."))), ":"), F.lit(""))]))), "\t"))
    return df.select(F.concat_ws("\t", *out).alias("value"))


def write_vcf(df: DataFrame, header: Header, path: str, samples: list[str] | None = None, compression: str = "none") -> None:
    """One sorted text file per partition, each with the header, by contig order and position."""
    names = header.samples if samples is None else samples
    head = [*header.lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *names] if names else [])])]
    ordered = sort_sites(df, header.contigs)
    lines = vcf_lines(ordered)

    def run(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
                first = False
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], ["value"])

    lines.mapInArrow(run, "value string").write.option("compression", compression).text(path)


def sort_sites(df: DataFrame, contigs: list[str] | None = None) -> DataFrame:
    """By contig (declared order, then name), position, REF and ALT."""
    place = F.array_position(F.array(*map(F.lit, contigs)), F.col("chrom")) if contigs else F.lit(0)
    return df.orderBy(F.when(place > 0, place).otherwise(F.lit(1 << 30)), "chrom", "pos", F.lower("ref"), F.array_join("alt", ","))


def read_regions(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """chrom, beg, end (1-based, closed) from bed (0-based, half-open), tab (1-based; position or interval) or reg
    ("chr:beg-end") text. The kind is taken from the name where it is not given."""
    kind = kind or ("bed" if re.search(r"\.bed(\.gz)?$", path) else "tab")
    x = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.trim("value").alias("v"))
    if kind == "reg":
        return parse_regions(x, "v")
    c = F.split("v", r"\s+")
    at = lambda i: F.get(c, F.lit(i))
    beg = at(1).cast("long") + (1 if kind == "bed" else 0)
    return x.select(at(0).alias("chrom"), beg.alias("beg"), F.coalesce(at(2).cast("long"), beg).alias("end"))


def parse_regions(df: DataFrame, col: str) -> DataFrame:
    """Region strings: chr, chr:pos, chr:beg-end, chr:beg-."""
    m = lambda i: F.nullif(F.regexp_extract(col, r"^(.*?)(?::([\d,]+)(-([\d,]*))?)?$", i), F.lit(""))
    num = lambda x: F.regexp_replace(x, ",", "").cast("long")
    beg = F.coalesce(num(m(2)), F.lit(1))
    end = F.when(m(2).isNull() | (m(3).isNotNull() & m(4).isNull()), F.lit(2147483646)).when(m(3).isNull(), beg).otherwise(num(m(4)))
    return df.select(m(1).alias("chrom"), beg.cast("long").alias("beg"), end.cast("long").alias("end"))


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """family, child, father, mother, sex."""
    c = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(c, F.lit(i))
    x = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    known = lambda i: F.when(~at(i).isin("0", "."), at(i))
    return x.select(at(0).alias("family"), at(1).alias("child"), known(2).alias("father"), known(3).alias("mother"), at(4).cast("int").alias("sex"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq: one row per contig. A record is a text up to the next '>', so files split between contigs."""
    x = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    return x.select(head.alias("chrom"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("seq"))


def tiles(fasta: DataFrame, width: int = 1 << 16) -> DataFrame:
    """chrom, tile, beg, seq: contigs cut into pieces that can be joined by (chrom, tile). Of a table of tiles (as read_fasta_tiles and tiled
    give), those of this width are taken as they are, others are put together anew; a contig in a cell is cut in one pass over it."""
    if {"tile", "beg"} <= set(fasta.columns):
        if fasta.schema["tile"].metadata.get("width") == width:
            return fasta.select("chrom", "tile", "beg", "seq")
        return tiled(fasta.select("chrom", F.col("beg").alias("pos"), F.col("seq").alias("text")), width)

    def cut(batches):
        for b in batches:
            for chrom, seq in zip(b.column(0).to_pylist(), b.column(1)):
                text = seq.as_py() or ""
                for first in range(0, len(text), width * TILES):
                    at = range(first, min(first + width * TILES, len(text)), width)
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(at), pa.string()), pa.array([a // width for a in at], pa.int64()), pa.array([a + 1 for a in at], pa.int64()), pa.array([text[a : a + width] for a in at], pa.string())], ["chrom", "tile", "beg", "seq"])

    return fasta.select("chrom", "seq").mapInArrow(cut, "chrom string, tile bigint, beg bigint, seq string")


TILES = 256  # of a batch


def tiled(pieces: DataFrame, width: int = 1 << 12) -> DataFrame:
    """chrom, tile, beg, seq of pieces of contigs (chrom, pos, text) that do not overlap and leave nothing out."""
    first = F.col("pos") - 1
    tile = F.explode(F.sequence(F.floor(first / width), F.floor((first + F.length("text") - 1) / width))).alias("tile")
    cut = pieces.filter("text <> ''").select("chrom", first.alias("first"), "text", tile)
    lo = F.greatest(F.col("first"), F.col("tile") * width)
    piece = F.substring("text", (lo - F.col("first") + 1).cast("int"), (F.col("tile") * width + width - lo).cast("int"))
    joined = cut.groupBy("chrom", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(lo.alias("lo"), piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return joined.select("chrom", F.col("tile").alias("tile", metadata={"width": width}), (F.col("tile") * width + 1).alias("beg"), "seq")


def read_fasta_tiles(spark: SparkSession, path: str, width: int = 1 << 12) -> DataFrame:
    """chrom, tile, beg, seq straight from FASTA lines: no cell, row or task ever holds a contig. Lines stay where the file's splits
    put them; each split tells how many bases it has of the contig that it begins in, and of those that begin in it, and running sums over
    splits (a few rows each) give every line its offset. Pieces of lines are then put together by tile."""
    lines = spark.read.text(path).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), "value")

    def number(batches):
        file = block = None
        n = at = row = 0
        for b in batches:
            out = []
            for f, k, line in zip(*(c.to_pylist() for c in b.columns)):
                if (f, k) != (file, block):
                    file, block, n, at, row = f, k, 0, 0, 0
                    out.append((f, k, 0, None, 0, ""))  # of the contig that goes on, if any
                if line.startswith(">"):
                    n, at = n + 1, 0
                    out.append((f, k, n, (line[1:].split() or [""])[0], 0, ""))
                    continue
                text = "".join(line.split()).upper()
                if text:
                    out.append((f, k, n, None, at, text))
                    at += len(text)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["file", "block", "n", "name", "at", "text"])

    rows = lines.mapInArrow(number, "file string, block bigint, n bigint, name string, at bigint, text string")
    path_of = scratch_path(spark, "fasta-lines")
    rows.write.parquet(path_of)
    rows = spark.read.schema(rows.schema).parquet(path_of)
    # a row for each split and each contig that begins in it
    parts = rows.groupBy("file", "block", "n").agg(F.max("name").alias("name"), F.max(F.col("at") + F.length("text")).alias("size"))
    order = Window.partitionBy("file").orderBy("block", "n")
    parts = parts.withColumn("contig", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(order))
    own = Window.partitionBy("file", "contig").orderBy("block", "n")
    parts = parts.withColumn("chrom", F.first("name", True).over(own)).withColumn("before", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.filter("text <> ''").join(parts.filter("chrom IS NOT NULL").select("file", "block", "n", "chrom", "before"), ["file", "block", "n"])
    return tiled(placed.select("chrom", (F.col("before") + F.col("at") + 1).alias("pos"), "text"), width)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """chrom, type, beg, end, strand, phase, id, parent, biotype, name of GFF3 features."""
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    x = spark.read.text(path).filter(~F.col("value").startswith("#") & F.contains("value", F.lit("\t")))
    a = F.str_to_map(F.rtrim(at(8)), F.lit(";"), F.lit("="))
    bare = lambda k: F.regexp_replace(a[k], r"^(gene|transcript|CDS|exon):", "")
    return x.select(at(0).alias("chrom"), at(2).alias("type"), at(3).cast("long").alias("beg"), at(4).cast("long").alias("end"), at(6).alias("strand"), F.when(at(7) != ".", at(7)).cast("int").alias("phase"), bare("ID").alias("id"), bare("Parent").alias("parent"), F.coalesce(a["biotype"], a["gene_biotype"]).alias("biotype"), a["Name"].alias("name"))


def read_gen(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """Variant rows from Oxford .gen text: five site columns (chrom:pos_ref_alt, id, pos, a0, a1), three probabilities a sample."""
    c = F.split("value", r"\s+")
    at = lambda i: F.get(c, F.lit(i))
    probs = lambda i: F.array(*(at(5 + 3 * i + k).cast("double") for k in range(3)))

    def sample(name: str, i: int) -> Column:
        p = probs(i)
        best = F.array_position(p, F.array_max(p)).cast("int")
        gt = F.when(F.array_max(p) > 0.33, F.when(best == 1, F.array(F.lit(0), F.lit(0))).when(best == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1)))).otherwise(F.array(F.lit(None).cast("int"), F.lit(None).cast("int")))
        return F.struct(F.lit(name).alias("sample"), gt.alias("gt"), F.lit(False).alias("phased"), p.alias("GP"))

    return spark.read.text(path).filter(F.trim("value") != "").select(F.regexp_extract(at(0), r"^([^:]+)", 1).alias("chrom"), at(2).cast("long").alias("pos"), F.array(at(1)).alias("id"), at(3).alias("ref"), F.array(at(4)).alias("alt"), F.array(*(sample(s, i) for i, s in enumerate(samples))).alias("samples"))


def gen_lines(df: DataFrame) -> DataFrame:
    """Oxford .gen text of variant rows; hard genotypes where no probabilities are."""
    has = "GP" in df.schema["samples"].dataType.elementType.names
    n = lambda s: F.size(F.filter(s["gt"], lambda a: a > 0))
    missing = lambda s: F.exists(s["gt"], lambda a: a.isNull())
    hard = lambda s: F.when(missing(s), "0.33 0.33 0.33").when(n(s) == 0, "1 0 0").when(n(s) == 1, "0 1 0").otherwise("0 0 1")
    one = (lambda s: F.coalesce(F.array_join(F.transform(s["GP"], lambda x: _number(x, T.DoubleType())), " "), hard(s))) if has else hard
    alt = F.get("alt", F.lit(0))
    key = F.concat_ws("_", F.concat_ws(":", "chrom", F.col("pos").cast("string")), "ref", alt)
    return df.select(F.concat_ws(" ", key, F.coalesce(F.get("id", F.lit(0)), key), F.col("pos").cast("string"), "ref", alt, F.array_join(F.transform("samples", one), " ")).alias("value"))


def hap_lines(df: DataFrame, legend: bool = False) -> DataFrame:
    """Haplotype text: two alleles a sample, '*' after unphased ones, '?' for missing; with the five site columns, or as the
    matrix of a hap/legend pair."""
    one = lambda s: F.array_join(F.transform(s["gt"], lambda a: F.concat(F.coalesce(a.cast("string"), F.lit("?")), F.when(s["phased"] | a.isNull(), "").otherwise("*"))), " ")
    matrix = F.array_join(F.transform("samples", one), " ")
    if legend:
        return df.select(matrix.alias("value"))
    alt = F.get("alt", F.lit(0))
    key = F.concat_ws("_", F.concat_ws(":", "chrom", F.col("pos").cast("string")), "ref", alt)
    return df.select(F.concat_ws(" ", key, F.coalesce(F.get("id", F.lit(0)), key), F.col("pos").cast("string"), "ref", alt, matrix).alias("value"))


def read_tsv_genotypes(spark: SparkSession, path: str, columns: list[str], sample: str) -> DataFrame:
    """chrom, pos, id, bases of a table of two-letter genotypes; columns name its fields ('-' skips one)."""
    c = F.split("value", r"\t")
    at = {k.lower(): F.get(c, F.lit(i)) for i, k in enumerate(columns) if k != "-"}
    x = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return x.select(at["chrom"].alias("chrom"), at["pos"].cast("long").alias("pos"), at.get("id", F.lit(None).cast("string")).alias("id"), at["aa"].alias("bases"), F.lit(sample).alias("sample"))


def expand_blocks(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row per position of reference blocks (chrom, pos, end): REF comes from the contig's sequence, joined by tile."""
    width = 1 << 16
    each = df.withColumn("pos", F.explode(F.sequence("pos", F.coalesce("end", "pos")))).withColumn("tile", F.floor((F.col("pos") - 1) / width))
    t = tiles(contigs, width).withColumnRenamed("beg", "_beg").withColumnRenamed("seq", "_seq")
    return each.join(t, ["chrom", "tile"], "left").withColumn("ref", F.coalesce(F.nullif(F.substring("_seq", (F.col("pos") - F.col("_beg") + 1).cast("int"), F.lit(1)), F.lit("")), "ref")).drop("tile", "_beg", "_seq", "end")
