"""The filter-expression language, compiled to Catalyst columns.

``compile_filter("QUAL > 10 && FMT/DP > 5", df)`` gives a site predicate and, where samples are involved, a mask over the
`samples` array. Nothing is evaluated row by row in Python: vectors become higher-order functions, scalars plain
comparisons that Parquet can prune by.

Every boolean node has two truths, that of the site and that of each sample. Missing values equal each other and nothing
else, are unequal to everything else, and are neither less nor greater. Vectors compare by any pair of elements. With
``compat=True`` operators of equal precedence group to the right and comparisons are done in single precision where both
sides are small enough, as the command-line language does.

FILTER is compared as a set, TYPE as the set of the ALTs' types. ``{STR}``, ``{INT}``, ``{FLOAT}`` and ``{}`` stand for columns that
are bound in turn (the values of the other side of a join), and ``py.name(..)`` calls a function of columns that is given by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import stats_math as M
from strandlake.functions.stats_math import variant_type

PRECEDENCE = {"||": 2, "|": 2, "&&": 3, "&": 3, "=": 5, "==": 5, "!=": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "~": 5, "!~": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|(?P<str>"[^"]*"(?:/i)?|'[^']*'(?:/i)?)|(?P<bound>\{(?:STR|INT|FLOAT)?\})|(?P<set>@[\w./-]+)|(?P<op>\|\||&&|==|!=|<=|>=|!~|[-+*/%<>=~|&()\[\],:])|(?P<name>(?:(?:INFO|FORMAT|FMT)/)?[A-Za-z_][\w.]*))""")
# Bits of the types of a site; one without variants is "ref".
TYPE_BITS = {"ref": 1, "snp": 2, "mnp": 4, "indel": 8, "other": 16, "bnd": 32, "overlap": 64}
AGGREGATES = {"MAX", "MIN", "AVG", "MEAN", "MEDIAN", "STDEV", "SUM", "COUNT"}


def names_in(path: str) -> list[str]:
    """The lines of a short list, from whatever file system Spark reads."""
    spark = SparkSession.getActiveSession()
    try:
        return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
    except AnalysisException as e:
        raise FilterError(f"cannot read {path!r}") from e


class FilterError(ValueError):
    """A name or a form that the expression cannot have."""


@dataclass
class Value:
    """A vector operand. kind: num or str (gt, filter and type: the genotype, FILTER and TYPE terms); col: array<double|string> of the site, or array of such arrays by sample;
    scalar: the plain column where there is one; literal: its value if constant."""

    kind: str
    col: Column
    per_sample: bool = False
    scalar: Column | None = None
    literal: object = None


@dataclass
class Truth:
    site: Column
    mask: Column | None = None


@dataclass
class Compiled:
    site: Column
    mask: Column | None

    def keep(self, df: DataFrame) -> DataFrame:
        return df.filter(self.site)

    def drop(self, df: DataFrame) -> DataFrame:
        """Exclusion: the mask is inverted sample by sample, and a site stays if a sample remains."""
        if self.mask is None:
            return df.filter(~self.site)
        return df.filter(F.exists(F.transform(self.mask, lambda x: ~x), lambda x: x))


def _array(c: Column, kind: str) -> Column:
    return F.array(c.cast("double" if kind == "num" else "string"))


class Compiler:
    def __init__(self, schema: T.StructType, samples: str = "samples", sets: dict[str, list[str]] | None = None, compat: bool = False, columns: dict[str, Column] | None = None, bound: list[Column] = (), functions: dict[str, Callable] | None = None):
        self.fields = {f.name: f.dataType for f in schema}
        self.samples, self.sets, self.compat, self.columns = samples, sets or {}, compat, columns or {}
        self.bound, self.functions = list(bound), functions or {}
        s = self.fields.get(samples)
        self.fmt = {f.name: f.dataType for f in s.elementType} if isinstance(s, T.ArrayType) and isinstance(s.elementType, T.StructType) else {}
        info = self.fields.get("info")
        self.info = {f.name: f.dataType for f in info} if isinstance(info, T.StructType) else {}

    # tokens and grammar
    def parse(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise FilterError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0
        out = self.binary(0)
        if self.i < len(self.tokens):
            raise FilterError(f"unexpected {self.tokens[self.i][1]!r}")
        return out

    def peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else (None, None)

    def take(self, want: str | None = None):
        kind, t = self.peek()
        if t is None or want is not None and t != want:
            raise FilterError(f"expected {want or 'more'}, found {t!r}")
        self.i += 1
        return kind, t

    def binary(self, least: int):
        left = self.unary()
        while (op := self.peek()[1]) in PRECEDENCE and PRECEDENCE[op] >= least and self.peek()[0] == "op":
            self.take()
            # to the right: operands of the same precedence bind first on that side
            right = self.binary(PRECEDENCE[op] + (0 if self.compat else 1))
            left = self.apply(op, left, right)
        return left

    def unary(self):
        if self.peek() == ("op", "-"):
            self.take()
            return self.arith("*", self.number(-1.0), self.unary())
        return self.primary()

    def primary(self):
        kind, t = self.take()
        if t == "(":
            out = self.binary(0)
            self.take(")")
            return out
        if kind == "num":
            return self.number(float(t))
        if kind == "str":
            fold = t.endswith("/i")
            s = t[1:-3] if fold else t[1:-1]
            return Value("str", F.split(F.lit(s), ",") if s else F.array(F.lit("")), literal=("(?i)" if fold else "") + s)
        if kind == "set":
            names = list(self.named(t[1:]))
            return Value("str", F.array(*map(F.lit, names)), literal=names)
        if kind == "bound":
            if not self.bound:
                raise FilterError(f"nothing is bound to {t}")
            c = self.bound.pop(0)
            return Value("str", F.array(c.cast("string")), scalar=c.cast("string")) if t in ("{}", "{STR}") else Value("num", F.array(c.cast("double")), scalar=c.cast("double"))
        if kind == "name" and self.peek() == ("op", "("):
            return self.call(t)
        if kind == "name":
            return self.subscript(self.resolve(t))
        raise FilterError(f"unexpected {t!r}")

    @staticmethod
    def number(x: float) -> Value:
        return Value("num", F.array(F.lit(x)), scalar=F.lit(x), literal=x)

    def named(self, name: str) -> list[str]:
        """A set that was given, or the lines of a file."""
        return self.sets[name] if name in self.sets else names_in(name)

    # names
    def resolve(self, name: str) -> Value:
        if name == "FILTER" and isinstance(self.fields.get("filters"), T.ArrayType):
            return Value("filter", F.coalesce("filters", F.array().cast("array<string>")))
        if name == "TYPE" and "alt" in self.fields and not {"TYPE", "type"} & self.fields.keys():
            bit = lambda a: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPE_BITS.items() for x in kv)), variant_type(F.col("ref"), a)), F.lit(16))
            bits = F.aggregate(F.transform("alt", bit), F.lit(0), lambda s, x: s.bitwiseOR(x))
            return Value("type", F.when(bits <= 1, 1).otherwise(bits.bitwiseAND(F.lit(126))))
        head, _, tail = name.partition("/")
        if head in ("FORMAT", "FMT") and tail:
            return self.sample_field(tail)
        if head == "INFO" and tail:
            if tail not in self.info:
                raise FilterError(f"no INFO field {tail!r}")
            return self.site_field(F.col(f"info.{tail}"), self.info[tail])
        if name in self.columns:
            return Value("num", F.array(self.columns[name].cast("double")), scalar=self.columns[name])
        for k in (name, name.lower()):
            if k in self.fields and k != self.samples:
                return self.site_field(F.col(k), self.fields[k])
        if name in self.info and name in self.fmt:
            raise FilterError(f"{name!r} is ambiguous: INFO/{name} or FMT/{name}")
        if name in self.info:
            return self.site_field(F.col(f"info.{name}"), self.info[name])
        for k in (name, name.lower()):
            if k in self.fmt:
                return self.sample_field(k)
        derived = self.derived(name)
        if derived is None:
            raise FilterError(f"unknown name {name!r}")
        return Value("num", F.array(derived.cast("double")) if name not in ("ILEN", "AC", "AF", "MAC", "MAF") else derived, scalar=derived if name not in ("ILEN", "AC", "AF", "MAC", "MAF") else None)

    @staticmethod
    def site_field(c: Column, t: T.DataType) -> Value:
        if isinstance(t, T.ArrayType):
            kind = "str" if isinstance(t.elementType, T.StringType) else "num"
            return Value(kind, F.coalesce(c.cast(f"array<{'string' if kind == 'str' else 'double'}>"), F.array(F.lit(None).cast("string" if kind == "str" else "double"))))
        if isinstance(t, T.StringType):
            return Value("str", F.when(c.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.split(c, ",")), scalar=c)
        if isinstance(t, T.BooleanType):
            c = F.coalesce(c.cast("int"), F.lit(0))
        return Value("num", F.array(c.cast("double")), scalar=c)

    def sample_field(self, name: str) -> Value:
        if name not in self.fmt:
            raise FilterError(f"no FORMAT field {name!r}")
        t = self.fmt[name]
        s = F.col(self.samples)
        if name.lower() == "gt":
            return Value("gt", s, per_sample=True)
        if isinstance(t, T.ArrayType):
            kind = "str" if isinstance(t.elementType, T.StringType) else "num"
            return Value(kind, F.transform(s, lambda x: x[name].cast(f"array<{'string' if kind == 'str' else 'double'}>")), per_sample=True)
        kind = "str" if isinstance(t, T.StringType) else "num"
        return Value(kind, F.transform(s, lambda x: F.array(x[name].cast("double" if kind == "num" else "string"))), per_sample=True)

    def derived(self, name: str) -> Column | None:
        """Columns that are computed where the table has none of that name."""
        s = F.col(self.samples)
        if name == "N_ALT" and "alt" in self.fields:
            return F.size("alt")
        if name == "ILEN" and "alt" in self.fields:
            return F.transform("alt", lambda a: (F.length(a) - F.length("ref")).cast("double"))
        if name == "N_SAMPLES" and self.fmt:
            return F.size(s)
        if name in ("N_MISSING", "F_MISSING") and "gt" in self.fmt:
            n = F.size(F.filter(s, lambda x: x["gt"].isNull() | F.exists(x["gt"], lambda a: a.isNull()))).cast("double")
            return n if name == "N_MISSING" else n / F.size(s)
        if name in ("AN", "AC", "AF", "MAC", "MAF") and "gt" in self.fmt:
            flat = F.filter(F.flatten(F.transform(s, lambda x: x["gt"])), lambda a: a.isNotNull())
            an = F.size(flat).cast("double")
            ac = F.transform(F.sequence(F.lit(1), F.size("alt")), lambda k: F.size(F.filter(flat, lambda a: a == k)).cast("double"))
            af = F.transform(ac, lambda x: F.when(an > 0, x / an))
            return {
                "AN": an, "AC": ac, "AF": af,
                "MAC": F.transform(ac, lambda x: F.when(x > an / 2, an - x).otherwise(x)),
                "MAF": F.transform(af, lambda x: F.when(x > 0.5, 1 - x).otherwise(x)),
            }[name]
        return None

    def subscript(self, v: Value) -> Value:
        if self.peek() != ("op", "["):
            return v
        self.take()
        parts = []
        while self.peek()[1] != "]":
            parts.append(self.take()[1])
        self.take("]")
        spec = "".join(parts)
        if spec.startswith("@") or "GT" in spec.split(":"):
            return self.chosen(v, spec)
        smpl, _, idx = spec.rpartition(":") if ":" in spec else (("", "", spec) if not v.per_sample else (spec, ":", "*"))
        pick = lambda a: a if idx in ("", "*") else F.array(*(F.get(a, F.lit(int(k))) for k in self.positions(idx))) if "-" not in idx or not idx.endswith("-") else F.slice(a, int(idx[:-1]) + 1, 1 << 20)
        if not v.per_sample:
            return Value(v.kind, pick(v.col))
        col = v.col
        if smpl not in ("", "*"):
            keep = [int(k) for k in self.positions(smpl)]
            col = F.transform(col, lambda x, i: F.when(i.isin(keep), x))
        return Value(v.kind, F.transform(col, pick) if v.kind != "gt" else col, per_sample=True)

    def chosen(self, v: Value, spec: str) -> Value:
        """Subscripts by a list of samples (@file, @file:index) or by genotype (GT, samples:GT: the values of the alleles that a
        sample has)."""
        if not v.per_sample:
            raise FilterError(f"[{spec}] is for FORMAT fields only")
        smpl, _, idx = spec.rpartition(":") if ":" in spec else (spec, "", "*") if spec.startswith("@") else ("*", "", spec)
        if v.kind == "gt":
            if idx == "GT":
                raise FilterError("genotypes have no values by genotype")
        none = F.array().cast(f"array<{'string' if v.kind == 'str' else 'double'}>")
        pick = lambda a: a if idx in ("", "*") else F.array(*(F.get(a, F.lit(k)) for k in self.positions(idx)))
        if idx == "GT":
            own = lambda a, s: F.when(F.exists(s["gt"], lambda g: g.isNull()), none).otherwise(F.transform(F.array_distinct(s["gt"]), lambda g: F.get(a, g)))
        else:
            own = lambda a, s: pick(a)
        if smpl.startswith("@"):
            keep = lambda s, i: s["sample"].isin(list(self.named(smpl[1:])))
        elif smpl in ("", "*"):
            keep = None
        else:
            places = self.positions(smpl)
            keep = lambda s, i: i.isin(places)
        pairs = F.zip_with(v.col, self.samples, lambda a, s: F.struct(a.alias("a"), s.alias("s"))) if v.kind != "gt" else F.transform(v.col, lambda s: F.struct(s.alias("a"), s.alias("s")))
        if v.kind == "gt":
            return Value("gt", F.transform(pairs, lambda x, i: x["a"] if keep is None else F.when(keep(x["s"], i), x["a"])), per_sample=True)
        take = lambda x, i: own(x["a"], x["s"]) if keep is None else F.when(keep(x["s"], i), own(x["a"], x["s"])).otherwise(none)
        return Value(v.kind, F.transform(pairs, take), per_sample=True)

    @staticmethod
    def positions(spec: str) -> list[int]:
        out = []
        for p in spec.split(","):
            a, _, b = p.partition("-")
            out += range(int(a), int(b or a) + 1)
        return out

    # functions
    def call(self, name: str):
        self.take("(")
        args = []
        while self.peek()[1] != ")":
            args.append(self.binary(0))
            if self.peek()[1] == ",":
                self.take()
        self.take(")")
        up = name.upper()
        if up in ("N_PASS", "F_PASS"):
            mask = args[0].mask
            if mask is None:
                raise FilterError(f"{name} needs a condition on samples")
            n = F.size(F.filter(mask, lambda x: x)).cast("double")
            n = n if up == "N_PASS" else n / F.size(mask)
            return Value("num", F.array(n), scalar=n)
        bare = up.removeprefix("SMPL_") if up.startswith("SMPL_") else up[1:] if name[0] == "s" and up[1:] in AGGREGATES else None
        if bare in AGGREGATES:
            return Value("num", F.transform(args[0].col, lambda a: F.array(M.reduce_array(bare, a))), per_sample=True)
        if up in AGGREGATES:
            x = F.flatten(args[0].col) if args[0].per_sample else args[0].col
            out = M.reduce_array(up, x)
            return Value("num", F.array(out), scalar=out)
        if up == "STRLEN":
            f = lambda a: F.transform(a, lambda x: F.length(x).cast("double"))
        elif up == "ABS":
            f = lambda a: F.transform(a, F.abs)
        elif up == "PHRED":
            f = lambda a: F.transform(a, lambda p: -10 * F.log10(p))
        elif name.startswith("py.") and name[3:] in self.functions:
            out = self.functions[name[3:]](*(x.scalar if x.scalar is not None else x.col for x in args))
            return Value("num", F.array(out.cast("double")), scalar=out)
        elif up in ("BINOM", "FISHER") and args[0].per_sample:
            return self.exact_by_sample(up, args)
        elif up in ("BINOM", "FISHER"):
            flat = F.concat(*(x.col for x in args))
            out = M.binom_two_sided(F.get(flat, F.lit(0)), F.get(flat, F.lit(1))) if up == "BINOM" else M.fisher_exact(*(F.get(flat, F.lit(i)) for i in range(4)))
            return Value("num", F.array(out), scalar=out)
        else:
            raise FilterError(f"unknown function {name!r}")
        v = args[0]
        if v.per_sample:
            return Value("num", F.transform(v.col, f), per_sample=True)
        return Value("num", f(v.col))

    def exact_by_sample(self, name: str, args: list[Value]) -> Value:
        """Exact tests of FORMAT fields. BINOM of one field compares the values of the two alleles of the genotype."""
        at = lambda x, i: F.get(x, F.lit(i))
        if name == "BINOM" and len(args) == 1:
            whole = lambda g: (F.size(g) >= 2) & ~F.exists(g, lambda v: v.isNull())
            one = lambda x, s: F.when(whole(s["gt"]), M.binom_two_sided(F.get(x, at(s["gt"], 0)), F.get(x, at(s["gt"], 1))))
            out = F.zip_with(args[0].col, self.samples, one)
        elif name == "BINOM":
            out = F.zip_with(args[0].col, args[1].col, lambda x, y: M.binom_two_sided(at(x, 0), at(y, 0)))
        else:
            test = lambda *x: F.when(~F.exists(F.array(*x), lambda v: v.isNull()), M.fisher_exact(*x))
            if len(args) == 1:
                out = F.transform(args[0].col, lambda x: test(*(at(x, i) for i in range(4))))
            else:
                out = F.zip_with(args[0].col, args[1].col, lambda x, y: test(at(x, 0), at(y, 0), at(x, 1), at(y, 1)))
        return Value("num", F.transform(out, lambda p: F.array(p)), per_sample=True)

    # operators
    def apply(self, op: str, a, b):
        if op in ("&&", "||", "&", "|"):
            return self.logic(op, self.truth(a), self.truth(b))
        if op in ("+", "-", "*", "/", "%"):
            return self.arith(op, a, b)
        return self.compare(op, a, b)

    @staticmethod
    def truth(x) -> Truth:
        if isinstance(x, Truth):
            return x
        if x.per_sample:
            mask = F.transform(x.col, lambda a: F.exists(a, lambda v: F.coalesce(v != 0, F.lit(False))))
            return Truth(F.exists(mask, lambda v: v), mask)
        return Truth(F.exists(x.col, lambda v: F.coalesce(v != 0, F.lit(False))))

    @staticmethod
    def arith(op: str, a: Value, b: Value) -> Value:
        if a.kind != "num" or b.kind != "num":
            raise FilterError(f"{op} needs numbers")
        one = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y), "%": lambda x, y: F.try_mod(x.cast("long"), y.cast("long")).cast("double")}[op]
        if a.scalar is not None and b.scalar is not None and not a.per_sample and not b.per_sample:
            s = one(a.scalar.cast("double"), b.scalar.cast("double"))
            return Value("num", F.array(s), scalar=s)

        def vector(x: Column, y: Column) -> Column:
            return F.when(F.size(x) == 1, F.transform(y, lambda v: one(F.get(x, F.lit(0)), v))).when(F.size(y) == 1, F.transform(x, lambda v: one(v, F.get(y, F.lit(0))))).when(F.size(x) == F.size(y), F.zip_with(x, y, one)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<double>"))

        if a.per_sample and b.per_sample:
            return Value("num", F.zip_with(a.col, b.col, vector), per_sample=True)
        if a.per_sample:
            return Value("num", F.transform(a.col, lambda x: vector(x, b.col)), per_sample=True)
        if b.per_sample:
            return Value("num", F.transform(b.col, lambda y: vector(a.col, y)), per_sample=True)
        return Value("num", vector(a.col, b.col))

    def pair(self, op: str, x: Column, y: Column) -> Column:
        """Numbers with missing values."""
        if self.compat:
            small = (F.abs(x) <= 16777216) & (F.abs(y) <= 16777216)
            x, y = F.when(F.coalesce(small, F.lit(True)), x.cast("float").cast("double")).otherwise(x), F.when(F.coalesce(small, F.lit(True)), y.cast("float").cast("double")).otherwise(y)
        if op in ("=", "=="):
            return x.eqNullSafe(y)
        if op == "!=":
            return ~x.eqNullSafe(y)
        return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))

    def compare(self, op: str, a, b):
        if isinstance(a, Truth) or isinstance(b, Truth):
            raise FilterError(f"{op} needs values")
        if {"filter", "type"} & {a.kind, b.kind}:
            v, lit = (a, b) if a.kind in ("filter", "type") else (b, a)
            if not isinstance(lit.literal, str) or op not in ("=", "==", "!=", "~", "!~"):
                raise FilterError(f"{v.kind} is compared with a text by =, !=, ~ or !~")
            return Truth(self.site_set(v, lit.literal, op))
        if "gt" in (a.kind, b.kind):
            v, lit = (a, b) if a.kind == "gt" else (b, a)
            mask = F.transform(v.col, lambda s: M.gt_is(s["gt"], lit.literal))
            mask = mask if op in ("=", "==") else F.transform(mask, lambda x: ~x)
            return Truth(F.exists(mask, lambda x: x), mask)
        if a.kind != b.kind and "." in (a.literal, b.literal):  # TAG="." asks for missing
            v = a if b.literal == "." else b
            a, b = v, Value(v.kind, F.array(F.lit(None).cast("double" if v.kind == "num" else "string")))
        if op in ("~", "!~"):
            if not isinstance(b.literal, str):
                raise FilterError("a pattern must be a literal")
            one = lambda x: F.exists(x, lambda v: F.coalesce(v.rlike(b.literal), F.lit(False)))
            if a.scalar is not None and not a.per_sample and "," not in b.literal:
                hit = F.coalesce(a.scalar.rlike(b.literal), F.lit(False))
                return Truth(hit if op == "~" else ~hit)
            test = one if op == "~" else (lambda x: ~one(x))
        elif isinstance(b.literal, list):
            one = lambda x: F.coalesce(F.arrays_overlap(x, b.col), F.lit(False))
            if a.scalar is not None and not a.per_sample:
                hit = F.coalesce(a.scalar.cast("string").isin(b.literal), F.lit(False))
                return Truth(hit if op in ("=", "==") else ~hit)
            test = one if op in ("=", "==") else (lambda x: ~one(x))
        elif "str" in (a.kind, b.kind):
            if op not in ("=", "==", "!="):
                raise FilterError(f"{op} needs numbers")
            one = lambda x, y: F.exists(x, lambda u: F.exists(y, lambda v: u.eqNullSafe(v)))
            if a.scalar is not None and isinstance(b.literal, str) and "," not in b.literal and b.literal != ".":
                hit = F.coalesce(a.scalar == b.literal, F.lit(False)) | F.coalesce(F.contains(a.scalar, F.lit(",")) & one(a.col, b.col), F.lit(False))
                return Truth(hit if op != "!=" else ~hit)
            both = one if op != "!=" else (lambda x, y: ~one(x, y))
            return self.spread(both, a, b)
        else:
            if a.scalar is not None and b.scalar is not None and not a.per_sample and not b.per_sample:
                x, y = (v.scalar.cast("double") if self.compat else v.scalar for v in (a, b))
                return Truth(self.pair(op, x, y))
            return self.spread(lambda x, y: F.exists(x, lambda u: F.exists(y, lambda v: self.pair(op, u, v))), a, b)
        if a.per_sample:
            mask = F.transform(a.col, test)
            return Truth(F.exists(mask, lambda x: x), mask)
        return Truth(test(a.col))

    @staticmethod
    def site_set(v: Value, text: str, op: str) -> Column:
        """FILTER: = the same set, ~ all of these are set; TYPE: = no ALT of another type, ~ some ALT of a type."""
        if v.kind == "type":
            try:
                bits = sum({TYPE_BITS[t.lower().removesuffix("s")] for t in text.split(",")})
            except KeyError:
                raise FilterError(f"no type {text!r}") from None
            hit = v.col == bits if op in ("=", "==", "!=") else v.col.bitwiseAND(F.lit(bits)) != 0
        else:
            want = F.array(*map(F.lit, [] if text == "." else text.split(";"))).cast("array<string>")
            same = F.array_sort(F.array_distinct(v.col)) == F.array_sort(F.array_distinct(want))
            hit = same if op in ("=", "==", "!=") or text == "." else F.size(F.array_except(want, v.col)) == 0
        return ~hit if op.startswith("!") else hit

    @staticmethod
    def spread(test, a: Value, b: Value) -> Truth:
        none = lambda x: F.coalesce(x, F.lit(False))
        if a.per_sample and b.per_sample:
            mask = F.zip_with(a.col, b.col, lambda x, y: none(test(x, y)))
        elif a.per_sample:
            mask = F.transform(a.col, lambda x: none(test(x, b.col)))
        elif b.per_sample:
            mask = F.transform(b.col, lambda y: none(test(a.col, y)))
        else:
            return Truth(none(test(a.col, b.col)))
        return Truth(F.exists(mask, lambda x: x), mask)

    @staticmethod
    def logic(op: str, a: Truth, b: Truth) -> Truth:
        both = a.mask is not None and b.mask is not None
        if op == "&" and both:
            mask = F.zip_with(a.mask, b.mask, lambda x, y: x & y)
            return Truth(F.exists(mask, lambda x: x), mask)
        if op in ("&", "&&"):
            site = a.site & b.site
            mask = F.zip_with(a.mask, b.mask, lambda x, y: x | y) if both else a.mask if a.mask is not None else b.mask
            return Truth(site, None if mask is None else F.transform(mask, lambda x: x & site))
        site = a.site | b.site
        if both:
            mask = F.zip_with(a.mask, b.mask, lambda x, y: x | y)
            return Truth(site, mask if op == "|" else F.transform(mask, lambda x: site))
        if a.mask is None and b.mask is None:
            return Truth(site)
        alone, mask = (a.site, b.mask) if a.mask is None else (b.site, a.mask)
        return Truth(site, mask if op == "|" else F.transform(mask, lambda x: x | alone))


def compile_filter(text: str, df: DataFrame, **kw) -> Compiled:
    c = Compiler(df.schema, **kw)
    t = c.truth(c.parse(text))
    return Compiled(t.site, t.mask)


def compile_value(text: str, df: DataFrame, **kw) -> Column:
    """A numeric expression as a column: a number where it is one, otherwise an array."""
    v = Compiler(df.schema, **kw).parse(text)
    return v.site if isinstance(v, Truth) else v.scalar if v.scalar is not None else v.col


def expand_grid(text: str) -> list[str]:
    """All expressions that lists in braces stand for: "{1,2}" gives one expression for each entry, several lists all pairs."""
    m = re.search(r"\{([^{}]*)\}", text)
    if not m:
        return [text]
    return [x for v in m[1].split(",") for x in expand_grid(text[: m.start()] + v.strip() + text[m.end() :])]
