"""The format-string projection language: literals, ``%TAG``, ``%TAG{i}``, ``%INFO/TAG``, ``%INFO`` and ``%FORMAT`` whole, functions
of the filter language such as ``%SUM(FMT/DP)`` or ``%N_PASS(GQ>20)``, and ``[ ... ]`` per sample.

A format compiles to one string column; missing values print as a dot. Columns of other dialects, such as row masks, are ordinary
columns and print by their names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.expr import Compiler
from strandlake.functions.stats_math import variant_type

PART = re.compile(r"\\n|\\t|\[|\]|%(?P<call>[A-Za-z_]\w*)\((?P<args>[^()]*)\)|%(?P<tag>/?[A-Za-z_][\w./]*)(?:\{(?P<i>\d+)\})?|[^%\\\[\]]+|.", re.S)
TRANSITIONS = (("A", "G"), ("G", "A"), ("C", "T"), ("T", "C"))
# Nucleotide codes for pairs of bases.
IUPAC = {"AA": "A", "CC": "C", "GG": "G", "TT": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def text_of(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.ArrayType):
        return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")).otherwise(".")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        c = F.coalesce(F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")), c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("."))


def gt_text(s: Column) -> Column:
    """0/1, 0|1, ./."""
    sep = F.when(F.coalesce(s["phased"], F.lit(False)), "|").otherwise("/")
    return F.coalesce(F.when(F.size(s["gt"]) > 0, F.replace(F.array_join(F.transform(s["gt"], lambda a: F.coalesce(a.cast("string"), F.lit("."))), "\u0001"), F.lit("\u0001"), sep)), F.lit("."))


def bases_text(s: Column) -> Column:
    """Genotypes as bases."""
    alleles = F.concat(F.array(F.col("ref")), F.col("alt"))
    sep = F.when(F.coalesce(s["phased"], F.lit(False)), "|").otherwise("/")
    return F.replace(F.array_join(F.transform(s["gt"], lambda a: F.coalesce(F.get(alleles, a), F.lit("."))), "\u0001"), F.lit("\u0001"), sep)


def iupac_text(s: Column) -> Column:
    """Genotypes of single bases as one code; other genotypes as bases with their separator."""
    alleles = F.transform(F.concat(F.array(F.col("ref")), F.col("alt")), F.upper)
    two = F.array_join(F.array_sort(F.transform(F.slice(F.concat(s["gt"], s["gt"]), 1, 2), lambda a: F.get(alleles, a))), "")
    table = F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv))
    code = F.when((F.size(s["gt"]) <= 2) & ~F.exists(s["gt"], lambda a: a.isNull()), F.try_element_at(table, two))
    return F.coalesce(code, bases_text(s))


class Projector:
    def __init__(self, df: DataFrame, samples: str = "samples", undefined: bool = False):
        self.types = {f.name: f.dataType for f in df.schema}
        self.samples, self.undefined, self.df = samples, undefined, df
        s = self.types.get(samples)
        self.fmt = {f.name: f.dataType for f in s.elementType} if isinstance(s, T.ArrayType) else {}
        i = self.types.get("info")
        self.info = {f.name: f.dataType for f in i} if isinstance(i, T.StructType) else {}

    def site(self, tag: str, i: str | None) -> Column:
        tag = tag.removeprefix("/")
        name = tag.removeprefix("INFO/")
        low = {"filter": "filters"}.get(name.lower(), name.lower())
        if low == "pos0":
            return (F.col("pos") - 1).cast("string")
        if low in ("end", "end0") and low not in self.types:
            end = F.col("pos") + F.length("ref") - 1
            return (end if low == "end" else end - 1).cast("string")
        if tag == "TYPE" and low not in self.types:
            kinds = F.array_sort(F.array_distinct(F.transform("alt", lambda a: F.upper(variant_type(F.col("ref"), a)))))
            return F.when(F.size("alt") == 0, "REF").otherwise(F.array_join(F.when(F.size(kinds) > 1, F.array_remove(kinds, "REF")).otherwise(kinds), ","))
        if tag == "INFO" and self.info:
            one = lambda k, t: F.when(F.col(f"info.{k}"), F.lit(k)) if isinstance(t, T.BooleanType) else F.when(F.col(f"info.{k}").isNotNull(), F.concat(F.lit(k + "="), text_of(F.col(f"info.{k}"), t)))
            return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*(one(k, t) for k, t in self.info.items()))), ";"), F.lit("")), F.lit("."))
        if tag == "FORMAT" and self.fmt:
            own = [k for k in self.fmt if k not in ("sample", "gt", "phased", "more")]
            each = F.transform(self.samples, lambda s: F.concat_ws(":", gt_text(s), *(text_of(s[k], self.fmt[k]) for k in own)))
            return F.concat_ws("\t", F.lit(":".join(["GT", *own])), each)
        if tag == "LINE":
            return F.concat_ws("\t", *(self.site(k, None) for k in ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER")), *([self.site("INFO", None)] if self.info else [F.lit(".")]), *([self.site("FORMAT", None)] if self.fmt else []))
        if low == "first_alt":
            return F.coalesce(F.get("alt", F.lit(0)), F.lit("."))
        if low == "is_ts":
            hit = F.lit(False)
            for a, b in TRANSITIONS:
                hit = hit | ((F.col("ref") == a) & (F.get("alt", F.lit(0)) == b))
            return F.coalesce(hit, F.lit(False)).cast("int").cast("string")
        for col, types, key in ((f"info.{name}", self.info, name),) if tag.startswith("INFO/") else ((name, self.types, name), (low, self.types, low), (f"info.{name}", self.info, name)):
            if key in types:
                c, t = F.col(col), types[key]
                if i is not None:
                    c, t = F.get(c, F.lit(int(i))), t.elementType
                if key == "filters":
                    return F.when(F.size(c) > 0, F.array_join(c, ";")).otherwise(".")
                return text_of(c, t)
        if self.undefined:
            return F.lit(".")
        raise ValueError(f"unknown tag {tag!r}")

    def of_sample(self, s: Column, tag: str, i: str | None) -> Column:
        name = tag.removeprefix("FORMAT/").removeprefix("FMT/")
        if name == "GT":
            return gt_text(s)
        if name == "TGT":
            return bases_text(s)
        if name == "IUPACGT":
            return iupac_text(s)
        if name == "SAMPLE" and "sample" in self.fmt:
            name = "sample"
        for k in (name, name.lower()):
            if k in self.fmt and not tag.startswith("/"):
                c, t = s[k], self.fmt[k]
                if i is not None:
                    c, t = F.get(c, F.lit(int(i))), t.elementType
                return text_of(c, t)
        return self.site(tag, i)

    def loop(self, parts: list) -> Column:
        """The samples' texts; values of functions come by the sample's place."""
        def one(s: Column, i: Column) -> Column:
            out = []
            for p in parts:
                if not isinstance(p, tuple):
                    out.append(p(s))
                elif p[1]:
                    out.append(F.coalesce(text_of(F.get(F.get(p[0], i), F.lit(0)), T.DoubleType()), F.lit(".")))
                else:
                    out.append(text_of(p[0], T.DoubleType()))
            return F.concat(*out) if out else F.lit("")

        return F.array_join(F.transform(self.samples, one), "")

    def value_of(self, name: str, args: str) -> tuple[Column, bool]:
        """A function of the filter language: its value, and whether it has one for each sample (an array of arrays). PBINOM is the
        phred-scaled binomial test of a field by genotype."""
        if name.upper() == "PBINOM":
            field = args if "/" in args else f"FMT/{args}"
            v = Compiler(self.df.schema, samples=self.samples).parse(f"BINOM({field})")
            return F.transform(v.col, lambda a: F.transform(a, lambda p: F.round(-10 * F.log10(F.greatest(p, F.lit(1e-300))), 6) + 0.0)), True
        v = Compiler(self.df.schema, samples=self.samples).parse(f"{name}({args})")
        return (v.col, True) if v.per_sample else (v.scalar if v.scalar is not None else F.get(v.col, F.lit(0)), False)

    def header(self, fmt: str, numbered: bool = True) -> str:
        """The names of the columns of a format, as one line; samples' fields are written once, with the sample left open."""
        names = [m["tag"] or f"{m['call']}({m['args']})" for m in PART.finditer(fmt) if m["tag"] or m["call"]]
        return "#" + "\t".join(f"[{i + 1}]{n}" if numbered else n for i, n in enumerate(names))

    def compile(self, fmt: str, newline: bool = False) -> Column:
        out, inner = [], None
        for m in PART.finditer(fmt):
            t = m[0]
            if t == "[":
                inner = []
            elif t == "]":
                out.append(self.loop(inner))
                inner = None
            elif m["call"]:
                c, each = self.value_of(m["call"], m["args"])
                if inner is None:
                    out.append(text_of(F.flatten(c), T.ArrayType(T.DoubleType())) if each else text_of(c, T.DoubleType()))
                else:
                    inner.append((c, each))
            elif m["tag"]:
                if inner is None:
                    out.append(self.site(m["tag"], m["i"]))
                else:
                    inner.append(lambda s, m=m: self.of_sample(s, m["tag"], m["i"]))
            else:
                lit = F.lit({"\\n": "\n", "\\t": "\t"}.get(t, t))
                out.append(lit) if inner is None else inner.append(lambda s, lit=lit: lit)
        if newline and not fmt.endswith("\\n"):
            out.append(F.lit("\n"))
        return F.concat(*out) if out else F.lit("")


def project(df: DataFrame, fmt: str, name: str = "line", **kw) -> DataFrame:
    return df.select(Projector(df, **kw).compile(fmt).alias(name))
