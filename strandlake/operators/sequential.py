"""Operators whose result depends on the order in which rows are taken: greedy pruning, overlap removal, cover, clustering.

They run group by group (a contig, a cluster); clusters are cut first by window functions so that a group is what rows can
influence each other, not a whole contig, wherever the semantics allow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import scratch_path


def prune(df: DataFrame, keys: list[str], at: str, n: int, width: int, weight: str | None = None) -> DataFrame:
    """At most n rows in any `width` positions, walking in order: when one comes too many, the row of least weight in the window
    goes (without weight, the newest). Rows more than `width` apart never meet, so runs are groups of their own."""
    w = Window.partitionBy(*keys).orderBy(at)
    x = df.withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(w) >= width, F.lit(True)).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    cols = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable").reset_index(drop=True)
        pos, value = pdf[at].to_numpy(), pdf[weight].to_numpy(float) if weight else None
        window: list[int] = []
        kept = np.ones(len(pdf), bool)
        for i in range(len(pdf)):
            window = [j for j in window if pos[i] - pos[j] < width] + [i]
            if len(window) > n:
                worst = min(window, key=lambda j: (value[j], -j)) if weight else i
                kept[worst] = False
                window.remove(worst)
        return pdf.loc[kept, cols]

    # many runs to a group: far apart as they are, they do not touch, and fewer groups cost less
    return x.groupBy(*keys, F.floor(F.col("_run") / 1024)).applyInPandas(run, df.schema)


def _clusters(df: DataFrame, keys: list[str], beg: str, end: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(beg, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.coalesce(F.col(beg) > reach, F.lit(True)).cast("int")).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def mark_overlaps(df: DataFrame, keys: list[str], beg: str, end: str, how: str = "overlap", weight: str | None = None) -> DataFrame:
    """Adds overlap: whether a row overlaps another (overlap), shares its position with one (dup), or is dropped when rows of
    least weight are taken out of a cluster, one by one, until none overlaps (min)."""
    if how == "dup":
        return df.withColumn("overlap", F.count("*").over(Window.partitionBy(*keys, beg)) > 1)
    if how == "overlap":
        w = Window.partitionBy(*keys).orderBy(beg, end)
        before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        after = F.lead(beg).over(w)
        return df.withColumn("overlap", F.coalesce(before >= F.col(beg), F.lit(False)) | F.coalesce(after <= F.col(end), F.lit(False)))
    x = _clusters(df, keys, beg, end)
    schema = df.withColumn("overlap", F.lit(True)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_c", beg, end], kind="stable").reset_index(drop=True)
        b, e, q, c = pdf[beg].to_numpy(), pdf[end].to_numpy(), pdf[weight].fillna(0).to_numpy(float), pdf["_c"].to_numpy()
        gone = np.zeros(len(pdf), bool)
        cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                gone[lo:hi] = thinned(b[lo:hi], e[lo:hi], q[lo:hi])
        return pdf.drop(columns="_c").assign(overlap=gone)[[f.name for f in schema]]

    def thinned(b: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
        meet = (b[:, None] <= e[None, :]) & (b[None, :] <= e[:, None])
        np.fill_diagonal(meet, False)
        gone = np.zeros(len(b), bool)
        for i in np.argsort(q, kind="stable"):
            if not meet.any():
                break
            gone[i] = True  # every row that is visited while overlaps remain
            meet[i, :] = meet[:, i] = False
        return gone

    return x.groupBy(*keys, F.floor(F.col("_c") / 256)).applyInPandas(run, schema)


def distinctive_blocks(df: DataFrame, site: str, sample: str, value: str, enough: int) -> DataFrame:
    """site, new_pairs, covered, block: sites by the number of sample pairs they tell apart, only those that add pairs, a new
    block once `enough` are covered. A fold over all sites in one order, so one task holds the samples of one site at a time
    and the set of covered pairs."""
    wide = df.groupBy(site).agg(F.sort_array(F.collect_list(F.struct(sample, value))).alias("_v"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, v in zip(pdf[site], pdf["_v"]):
            names, vals = [x[sample] for x in v], [x[value] for x in v]
            rows.append((s, {(names[i], names[j]) for i in range(len(v)) for j in range(i) if vals[i] != vals[j]}))
        rows.sort(key=lambda r: (-len(r[1]), r[0]))
        covered, block, out = set(), 0, []
        for s, p in rows:
            new = p - covered
            if new:
                covered |= new
                out.append((s, len(new), len(covered), block))
                if len(covered) >= enough:
                    covered, block = set(), block + 1
        return pd.DataFrame(out, columns=[site, "new_pairs", "covered", "block"])

    kind = df.schema[site].dataType.simpleString()
    return wide.groupBy().applyInPandas(pairs, f"{site} {kind}, new_pairs long, covered long, block long")


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """a, b, d, root: the edges of a least spanning forest, with a name for the tree of each. In every round each tree takes the least edge that
    leaves it (of equal ones the first by names, so there are no circles), and trees that an edge joins become one; rounds are at most the logarithm
    of the number of nodes. All rounds are joins and map-side combined aggregations, each a table of its own, so no task holds a
    tree. Edges from a node to itself, or without a distance, play no part."""
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & F.col(d).isNotNull())
    e = e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(d).alias("d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    e = kept(e.select("*", F.col("a").alias("x"), F.col("b").alias("y")), "forest-edges")  # x, y: the trees of its ends
    taken, trees = None, e.select(F.col("x").alias("node")).unionByName(e.select(F.col("y").alias("node"))).distinct().withColumn("root", F.col("node"))
    while not e.isEmpty():
        both = e.unionByName(e.select("a", "b", "d", F.col("y").alias("x"), F.col("x").alias("y")))
        best = kept(both.groupBy("x").agg(F.min(F.struct("d", "a", "b", "y")).alias("e")).select("x", F.col("e.y").alias("to"), "e.a", "e.b", "e.d"), "forest-best")
        new = best.select("a", "b", "d").distinct()
        taken = kept(new if taken is None else taken.unionByName(new), "forest-taken")
        # two trees that take the same edge point at each other: the lesser is the root; then pointers are followed to their roots
        back = best.select(F.col("x").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to", "left").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("up"))
        up = kept(up, "forest-up")
        while True:
            far = up.select(F.col("x").alias("up"), F.col("up").alias("far"))
            up = kept(up.join(far, "up", "left").select("x", F.coalesce("far", "up").alias("next"), F.col("up").alias("was")), "forest-up")
            moved = not up.filter("next <> was").isEmpty()
            up = up.select("x", F.col("next").alias("up"))
            if not moved:
                break
        trees = kept(trees.join(up.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "forest-trees")
        e = e.join(up.withColumnRenamed("up", "_x"), "x").join(up.select(F.col("x").alias("y"), F.col("up").alias("_y")), "y").filter("_x <> _y")
        e = e.select("d", "a", "b", F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"))
        # of the edges between two trees only the least can ever be taken
        e = kept(e.groupBy("x", "y").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.a", "e.b", "e.d", "x", "y"), "forest-edges")
    if taken is None:
        return trees.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("d"), "root")
    return taken.join(trees.withColumnRenamed("node", "a"), "a").select("a", "b", "d", "root")


def cluster_samples(dist: DataFrame, a: str, b: str, d: str, linkage: str = "single", threshold: float | None = None) -> DataFrame:
    """sample, cluster (its least name), height (of its last joining): agglomerative clustering of a table of distances of pairs, cut at the threshold
    (by default half the greatest distance).

    Single linkage is the least spanning forest of the pairs within the threshold, and goes over executors. Complete linkage has no such
    form: it folds the table of pairs of samples, not rows of data, in one task."""
    if linkage == "single":
        limit = threshold if threshold is not None else (dist.agg(F.max(d)).first()[0] or 0) / 2
        near = spanning_forest(dist.filter(F.col(d) <= limit), a, b, d)
        tree = near.groupBy("root").agg(F.least(F.min("a"), F.min("b")).alias("cluster"), F.max("d").alias("height"))
        of = near.select("root", F.explode(F.array("a", "b")).alias("sample")).distinct().join(tree, "root").select("sample", "cluster", F.col("height").cast("double").alias("height"))
        names = dist.select(F.col(a).alias("sample")).unionByName(dist.select(F.col(b).alias("sample"))).filter("sample IS NOT NULL").distinct()
        return names.join(of, "sample", "left").select("sample", F.coalesce("cluster", "sample").alias("cluster"), F.coalesce("height", F.lit(0.0)).alias("height"))
    return _complete_linkage(dist, a, b, d, threshold)


def _complete_linkage(dist: DataFrame, a: str, b: str, d: str, threshold: float | None) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf[a], *pdf[b]})
        at = {n: i for i, n in enumerate(names)}
        m = np.full((len(names),) * 2, np.inf)
        for x, y, v in zip(pdf[a], pdf[b], pdf[d]):
            m[at[x], at[y]] = m[at[y], at[x]] = v
        groups, height = {i: [i] for i in at.values()}, {i: 0.0 for i in at.values()}
        limit = threshold if threshold is not None else float(np.nanmax(np.where(np.isfinite(m), m, 0))) / 2
        while len(groups) > 1:
            ids = sorted(groups)
            sub = m[np.ix_(ids, ids)]
            k = int(np.argmin(np.where(np.eye(len(ids), dtype=bool), np.inf, sub)))
            i, j = sorted((ids[k // len(ids)], ids[k % len(ids)]))
            v = m[i, j]
            if not v <= limit:
                break
            row = np.maximum(m[i], m[j])
            m[i], m[:, i] = row, row
            groups[i] += groups.pop(j)
            height.update(dict.fromkeys(groups[i], v))
        return pd.DataFrame([(names[x], min(names[y] for y in g), height[x]) for g in groups.values() for x in g], columns=["sample", "cluster", "height"])

    kind = dist.schema[a].dataType.simpleString()
    return dist.groupBy().applyInPandas(run, f"sample {kind}, cluster {kind}, height double")


def depth_blocks(df: DataFrame, keys: list[str], at: str, depth: str, bounds: list[int]) -> DataFrame:
    """Reference blocks: consecutive positions whose depth lies in one range (bounds are lower ends); beg, end and least depth."""
    label = F.lit(-1)
    for k, v in enumerate(sorted(bounds)):
        label = F.when(F.col(depth) >= v, k).otherwise(label)
    w = Window.partitionBy(*keys).orderBy(at)
    x = df.withColumn("_l", label)
    new = (F.col("_l") != F.lag("_l").over(w)) | (F.col(at) - F.lag(at).over(w) > 1)
    x = x.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.filter("_l >= 0").groupBy(*keys, "_b", "_l").agg(F.min(at).alias("beg"), F.max(at).alias("end"), F.min(depth).alias("min_depth")).withColumnRenamed("_l", "range").drop("_b")
