"""Segments that phased haplotypes share, along contigs: a child's with those of its parents (eight states), or those of two unrelated samples
(seven states), as hidden Markov models decoded by tiles (see hmm.decode).

Rows have one site and a phased genotype (array of two alleles) for each person; rows with a null or missing genotype, or another
ploidy, say nothing and go."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import hmm
from strandlake.operators.segments import stretches

#: States of a trio: haplotype (1, 2) of the mother and of the father, and whether the child's first haplotype is the mother's.
TRIO = [(m, f, first) for first in (True, False) for m, f in ((1, 1), (1, 2), (2, 1), (2, 2))]
#: States of a pair: which haplotype of the first sample the second one's first and second haplotypes share (0: none).
PAIR = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 2), (2, 1)]


def trio_transition(switch: float = 2e-8) -> list[list[float]]:
    """A switch within a parent costs `switch`; the child's haplotypes never change their parents."""
    t = np.array([[0.0 if a == b or a[2] != b[2] else switch ** ((a[0] != b[0]) + (a[1] != b[1])) for b in TRIO] for a in TRIO])
    return (t + np.diag(1 - t.sum(1))).tolist()


def pair_transition(switch: float = 2e-8) -> list[list[float]]:
    """A haplotype that begins, or ends, to be shared costs `switch`; to end one and begin another costs it twice."""
    one = {(1, 0): (1, 2), (0, 1): (2, 1), (2, 0): (2, 1), (0, 2): (1, 2)}

    def cost(a, b) -> int:
        if 0 not in a and 0 not in b:
            return 2
        if a == (0, 0) or b == (0, 0):
            return 2 if 0 not in a or 0 not in b else 1
        if 0 in a and 0 in b:  # both share one: twice where person and haplotype are both others
            return 2 if sum(a) != sum(b) and (a[0] > 0) != (b[0] > 0) else 1
        half, full = (a, b) if 0 in a else (b, a)
        return 1 if one[half] == full else 2

    t = np.array([[0.0 if a == b else switch ** cost(a, b) for b in PAIR] for a in PAIR])
    return (t + np.diag(1 - t.sum(1))).tolist()


def _whole(g: Column) -> Column:
    return F.coalesce((F.size(g) == 2) & ~F.exists(g, lambda a: a.isNull() | (a < 0)), F.lit(False))


def _equal(a: Column, b: Column, error: float) -> Column:
    return F.when(a == b, 1 - error).otherwise(error)


def trio_segments(df: DataFrame, keys: list[str], at: str = "pos", child: str = "child", mother: str = "mother", father: str = "father", switch: float = 2e-8, error: float = 1e-9, width: int = hmm.WIDTH) -> DataFrame:
    """keys, beg, end, sites, and of each stretch the parental haplotypes that the child has (mother_hap, father_hap, mother_first: whether the
    child's first one is the mother's), and whether the mother's or the father's switched since the stretch before.
    Sites that no transmission explains are left out."""
    x = df.filter(_whole(F.col(child)) & _whole(F.col(mother)) & _whole(F.col(father)))
    x = x.filter(F.arrays_overlap(mother, child) & F.arrays_overlap(father, child))
    e = [F.get(child, F.lit(k)) for k in (0, 1)]
    emit = []
    for m, f, first in TRIO:
        of_mother, of_father = (e[0], e[1]) if first else (e[1], e[0])
        emit.append(_equal(of_mother, F.get(mother, F.lit(m - 1)), error) * _equal(of_father, F.get(father, F.lit(f - 1)), error))
    x = x.select(*keys, F.col(at), *(v.alias(f"_e{k}") for k, v in enumerate(emit)))
    s = hmm.decode(x, keys, at, [f"_e{k}" for k in range(8)], trio_transition(switch), [1 / 8] * 8, width=width)
    out = stretches(s, keys, at, ["state"], {}, width)
    state = lambda k: F.get(F.array(*(F.lit(v[k]) for v in TRIO)), F.col("state"))
    out = out.select(*keys, "beg", "end", "sites", state(0).alias("mother_hap"), state(1).alias("father_hap"), state(2).alias("mother_first"))
    w = Window.partitionBy(*keys).orderBy("beg")  # a row a stretch
    return out.withColumns({f"{p}_switch": F.coalesce(F.col(f"{p}_hap") != F.lag(f"{p}_hap").over(w), F.lit(False)) for p in ("mother", "father")})


def switches(df: DataFrame, segments: DataFrame, keys: list[str], child: str = "child", mother: str = "mother", father: str = "father") -> DataFrame:
    """keys, parent, hets (its heterozygous sites among those that count), switches and their rate by site between the first and the last of them."""
    x = df.filter(_whole(F.col(child)) & _whole(F.col(mother)) & _whole(F.col(father)))
    x = x.filter(F.arrays_overlap(mother, child) & F.arrays_overlap(father, child))
    het = lambda g: F.count_if(F.get(g, F.lit(0)) != F.get(g, F.lit(1)))
    n = x.groupBy(*keys).agg(het(mother).alias("mother_hets"), het(father).alias("father_hets"), F.lit(0).cast("long").alias("mother_n"), F.lit(0).cast("long").alias("father_n"))
    s = segments.groupBy(*keys).agg(*(F.lit(0).cast("long").alias(f"{p}_hets") for p in ("mother", "father")), *(F.count_if(f"{p}_switch").alias(f"{p}_n") for p in ("mother", "father")))
    g = n.unionByName(s).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("mother_hets", "father_hets", "mother_n", "father_n")))
    g = g.select(*keys, F.inline(F.array(*(F.struct(F.lit(p).alias("parent"), F.col(f"{p}_hets").alias("hets"), F.col(f"{p}_n").alias("switches")) for p in ("mother", "father")))))
    return g.withColumn("rate", F.when(F.col("hets") > 1, F.col("switches") / (F.col("hets") - 1)).otherwise(0.0))


def pair_segments(df: DataFrame, keys: list[str], at: str = "pos", one: str = "one", other: str = "other", switch: float = 2e-8, error: float = 1e-9, af: float = 0.5, width: int = hmm.WIDTH) -> DataFrame:
    """keys, beg, end, sites, first_from, second_from: the haplotypes (1, 2; 0: none) of `one` that the first and second haplotypes of `other` share.
    af: the ALT frequency by which haplotypes that are not shared agree."""
    x = df.filter(_whole(F.col(one)) & _whole(F.col(other)))
    a, c = [F.get(one, F.lit(k)) for k in (0, 1)], [F.get(other, F.lit(k)) for k in (0, 1)]
    free = lambda u, v: F.when(u != v, af * (1 - af)).when(u == 0, (1 - af) * (1 - af)).otherwise(af * af)
    emit = []
    for first, second in PAIR:
        if not first and not second:
            p = free(a[0], c[0]) * free(a[0], c[1]) * free(a[1], c[0]) * free(a[1], c[1])
        elif first and second:
            p = _equal(a[first - 1], c[0], error) * _equal(a[second - 1], c[1], error)
        else:
            mine, its = (first, 0) if first else (second, 1)
            p = _equal(a[mine - 1], c[its], error) * free(a[2 - mine], c[1 - its])
        emit.append(p)
    x = x.select(*keys, F.col(at), *(v.alias(f"_e{k}") for k, v in enumerate(emit)))
    s = hmm.decode(x, keys, at, [f"_e{k}" for k in range(7)], pair_transition(switch), [1 / 7] * 7, width=width)
    state = lambda k: F.get(F.array(*(F.lit(v[k]) for v in PAIR)), F.col("state"))
    return stretches(s, keys, at, ["state"], {}, width).select(*keys, "beg", "end", "sites", state(0).alias("first_from"), state(1).alias("second_from"))
