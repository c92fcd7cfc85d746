"""N-gram Jaccard join by vertical partitioning (operator 6).

The global order of n-grams is that of their hashes; fragments are ranges of it. Sets of sizes n <= m that reach the
threshold differ in at most d elements, d = (100 - T)(n + m) / (100 + T). Cut into d + 1 fragments, they agree in one of
them, so whatever shares a fragment is a candidate and nothing else can be a link. How many fragments: sets are put into
classes of sizes, each as wide as two steps of the threshold; a set takes part in the cutting of its own class and, if it can
have partners there, of the one below; partners are never further apart. A fragment that is empty says little, so for such a one those after it
go into the key. As d differences lie in d + 1 fragments, there is a fragment without any after which, going around, the next k hold k at most, for
every k (were there none, the sums over runs of fragments that each break the rule would exceed d). Where that fragment is empty in both sets, the
next is taken whole and without each of its elements; where nothing might be left of it, the one after that too, without as many elements
as the rule still allows, and so on for AFTER fragments. So a key names an n-gram, save those of sets with next to nothing in AFTER + 1 fragments, and
the sets that share one do not grow in proportion with the table, as those with an empty fragment and nothing in the next do.

Links are counted as the method says: the sets of candidates are cut into fragments, partial overlaps are counted a few
fragments at a time, and summed for each pair; a pair that what is left could not bring to the threshold is not counted on.

Nearly all keys occur once. Keys are therefore taken in SLICES of the key space, one after another, and the shuffle files of a
slice are gone before the next: whatever the size of the input, a SLICES-th of the keys is on the way at a time. Sets are made
again from the texts, and only those of pairs that a sketch of both does not rule out.

What is asked for are components, so pairs inside one need not be counted. Sets that are equal are one class with one
representative. In every group of sets that share a fragment, all are first compared with one of them, the most central
(that with the most company in its fragments), and components of those links are formed. What is left are families of
groups that hold more than one component. They are compared in blocks: a block holds sets of about one size, of one component or of
several small ones, and two blocks meet in one task unless both are of the same component. First with the sketches alone: what has no
possible partner on the other side goes. Then the overlaps of all pairs that are left are products of incidence matrices, a
fragment of the n-gram order at a time, summed. Only one link for each two components
leaves a task, so pairs are never rows, however large a family is (but for units of FEW sets, where pairs are less than FEW
times the rows); a family is the unit up to `family` sets, and beyond that the single groups are. No pair that could join two components is left out.

Defined results: a null text or one without words has the empty set and links with nothing; a text of fewer words than an
n-gram has one element, all of them; very long texts are sets like any other; a null id counts as larger than every id, and
is null again in the result; rows that share an id are linked if their texts are, and results are by row; an empty table gives
an empty one; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import WordHashes, free, hashed, map_arrow, mix64, quoted, remove, signed, two_longs, window_hashes, words, written
from strandlake.llm.components import components

BASE = 0xA0761D6478BD642F
PARTS, AT_ONCE = 8, 2  # fragments in which overlaps are counted, and how many of them in one job
SLICES = 8  # of the key space
FRAGMENT = 8192  # n-grams of a fragment where blocks meet
BLOCK, BLOCK_GRAMS = 512, 1 << 19  # sets, and n-grams, of a block
SKETCH = 256  # ranges of the n-gram order whose elements are counted for each set
FEW = 128  # sets of a unit whose pairs are taken as they are
AFTER = 6  # fragments after an empty one that may go into its keys
LAST = (1 << 63) - 1  # stands for a null id


def n_grams(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct n-word n-grams of a text in ASCII lower case; the whole sequence where it is shorter."""
    ws = [w.lower() for w in words(text)]
    if not ws:
        return np.empty(0, np.uint64)
    h = hashes.of(ws)
    if len(ws) < n:
        return window_hashes(np.concatenate([np.array([len(ws)], np.uint64), h]), len(ws) + 1, BASE)
    return np.unique(window_hashes(h, n, BASE))


class Cutting:
    """Size classes and their fragments for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.fragments = [1], []

    def scheme(self, size: int) -> int:
        while self.low[-1] <= size:
            lo, t = self.low[-1], self.percent
            hi = lo * 10_000 // (t * t)
            self.low.append(hi + 1)
            self.fragments.append((100 - t) * (hi + hi * 100 // t) // (100 + t) + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def schemes(self, size: int) -> list[int]:
        """The classes in whose cutting a set of this size takes part."""
        c = self.scheme(size)
        below = c > 0 and self.percent * size <= 100 * (self.low[c] - 1)
        return [k for k in ([c - 1, c] if below else [c]) if self.fragments[k] > 1]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of a set; two sets that are linked and not equal share one. Odd keys are those of empty fragments."""
        if not len(s):
            return s
        out = [self._keys(s, k, self.fragments[k]) for k in self.schemes(len(s))]
        return np.unique(np.concatenate(out)) if out else s[:0]

    @staticmethod
    def _keys(s: np.ndarray, scheme: int, n: int) -> np.ndarray:
        part = (s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
        mixed = mix64(s ^ np.uint64(BASE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        whole = total[cut[1:]] - total[cut[:-1]]
        tag = mix64(np.arange(n, dtype=np.uint64) + np.uint64(scheme << 32))
        full = np.diff(cut) > 0
        out = [mix64(whole[full] ^ tag[full]) & ~np.uint64(1)]
        for f in np.flatnonzero(~full).tolist():
            most, step, last = 1, 1, min(AFTER, n - 1)  # most: differences that the next fragment may have
            while True:
                g, at = (f + step) % n, tag[f : f + 1] if step == 1 else mix64(tag[f : f + 1] + np.uint64(step))
                part = mixed[cut[g] : cut[g + 1]]
                if len(part):
                    out.append(mix64(mix64(left_over(part, whole[g], most) ^ at) ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1))
                if len(part) > most:
                    break
                if step == last:  # nothing to hold on to
                    out.append(mix64(mix64(at) ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1))
                    break
                most, step = most - len(part) + 1, step + 1
        return np.concatenate(out)


def left_over(part: np.ndarray, total: np.uint64, most: int) -> np.ndarray:
    """The sums of all that part, whose sum is total, can be without up to `most` of its elements, but for nothing at all."""
    out = [np.full(1, total)]
    for k in range(1, min(most, len(part) - 1) + 1):
        out.append(total - (part if k == 1 else part[np.array(list(combinations(range(len(part)), k)))].sum(1, dtype=np.uint64)))
    return np.concatenate(out)


def set_pass(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each row (id, text, h1, h2): id, h1, h2, the 128-bit hash and size of its set, a sketch (elements in each of SKETCH
    ranges), and its keys by slice of the key space."""
    slices = [f"keys{k}" for k in range(SLICES)]

    def run(batches):
        hashes, cutting = WordHashes(6), Cutting(percent)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    s = n_grams(text, n, hashes)
                    keys = cutting.keys(s)
                    slot = (keys >> np.uint64(1)) % np.uint64(SLICES)
                    sketch = np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 32767).astype(np.int16)
                    rows.append((*two_longs(xxhash.xxh3_128_intdigest(s.tobytes())), len(s), sketch, *(signed(keys[slot == i]) for i in range(SLICES))))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int16()), *[pa.list_(pa.int64())] * SLICES]
                arrays = [part.column(0), part.column(2), part.column(3), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "h1", "h2", "c1", "c2", "n", "sketch", *slices])

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts, run, f"id {kind}, h1 bigint, h2 bigint, c1 bigint, c2 bigint, n bigint, sketch array<smallint>, " + ", ".join(f"{x} array<bigint>" for x in slices))


def fragment_pass(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, known, n, g0, g1, ..: the sets of the nodes wanted (node, known, h1, h2) in PARTS fragments. Equal texts are one before
    they are moved."""
    fragments = [f"g{k}" for k in range(PARTS)]

    def run(batches):
        hashes = WordHashes(6)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                out = []
                for node, known, text in zip(*(c.to_pylist() for c in b.slice(k, 128).columns)):
                    s = n_grams(text, n, hashes)
                    part = (s >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)
                    cut = np.searchsorted(part, np.arange(PARTS + 1, dtype=np.uint64))
                    out.append((node, known, len(s), *(signed(s[cut[p] : cut[p + 1]]) for p in range(PARTS))))
                kinds = [pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * PARTS]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["node", "known", "n", *fragments])

    one = texts.groupBy("h1", "h2").agg(F.first("text").alias("text")).join(wanted, ["h1", "h2"])
    return map_arrow(one.select("node", "known", "text"), run, "node bigint, known boolean, n bigint, " + ", ".join(f"{x} array<bigint>" for x in fragments))


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that may reach the threshold: sets differ in at least the sum of the differences of their sketches."""
    x, y = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda u, v: F.abs(u.cast("int") - v)), F.lit(0), lambda t, v: t + v)
    return pairs.join(x, "a").join(y, "b").filter(apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def linked(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: overlaps of AT_ONCE fragments at a time, summed for each pair."""
    state, path = pairs.withColumn("common", F.lit(0).cast("long")).withColumn("resta", F.lit(None).cast("long")).withColumn("restb", F.lit(None).cast("long")), None
    for k in range(0, PARTS, AT_ONCE):
        for side in "ab":
            state = state.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), *(F.col(f"g{i}").alias(f"{side}{i}") for i in range(k, k + AT_ONCE))), side)
        shared, seen = (sum((f(i) for i in range(k, k + AT_ONCE)), F.lit(0)) for f in (lambda i: F.size(F.array_intersect(f"a{i}", f"b{i}")), lambda i: F.size(f"a{i}")))
        seen_b = sum((F.size(f"b{i}") for i in range(k, k + AT_ONCE)), F.lit(0))
        state = state.select("a", "b", "na", "nb", (F.col("common") + shared).alias("common"), (F.coalesce("resta", "na") - seen).alias("resta"), (F.coalesce("restb", "nb") - seen_b).alias("restb"))
        most = F.col("common") + F.least("resta", "restb")
        state = state.filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).drop("na", "nb")
        before, (state, path) = path, written(spark, state, "jaccard-overlaps")
        if before:
            remove(spark, before)
    return state.select("a", "b")


def block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between the components of two blocks, one for each two components. Rows: b1, b2, block, node, n, label, grams."""
    b1, b2 = pdf["b1"].iloc[0], pdf["b2"].iloc[0]
    sides = [pdf[pdf["block"] == b].reset_index(drop=True) for b in ((b1,) if b1 == b2 else (b1, b2))]
    rows = pd.concat(sides, ignore_index=True)
    left = np.arange(len(sides[0]))
    right = left if len(sides) == 1 else np.arange(len(sides[0]), len(rows))
    if not len(left) or not len(right):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    size = rows["n"].to_numpy(np.int64)
    grams = np.concatenate([np.asarray(g, np.int64) for g in rows["grams"]])
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for lo in range(0, width, FRAGMENT):  # partial overlaps, summed
        cut = slice(*np.searchsorted(column, [lo, lo + FRAGMENT]))
        m = np.zeros((len(rows), min(FRAGMENT, width - lo)), np.float32)
        m[owner[cut], column[cut] - lo] = 1
        common += m[left] @ m[right].T
    label = rows["label"].to_numpy()
    ok = (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (label[left][:, None] != label[right][None, :])
    i, j = np.nonzero(ok)
    node = rows["node"].to_numpy()
    out = pd.DataFrame({"a": node[left[i]], "b": node[right[j]], "la": label[left[i]], "lb": label[right[j]]})
    return out.drop_duplicates(["la", "lb"])[["a", "b"]]


def pairs_in_units(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of sets of different labels in the same small unit that sizes and sketches do not rule out."""
    pdf = pdf.sort_values("unit", kind="stable")
    node, size, label = (pdf[c].to_numpy(np.int64) for c in ("node", "n", "label"))
    sketch, unit = np.array(pdf["sketch"].tolist(), np.int16).reshape(len(pdf), SKETCH), pdf["unit"].to_numpy()
    cuts = np.flatnonzero(np.diff(unit)) + 1
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in np.split(np.arange(len(pdf)), cuts):
        i, j = np.triu_indices(len(at), 1)
        i, j = at[i], at[j]
        ok = (label[i] != label[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        if len(i):
            apart = np.abs(sketch[i] - sketch[j]).sum(1, dtype=np.int64)
            ok = apart * (100 + percent) <= (100 - percent) * (size[i] + size[j])
            out_a.append(np.minimum(node[i[ok]], node[j[ok]]))
            out_b.append(np.maximum(node[i[ok]], node[j[ok]]))
    return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def block_hints(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of the rows of two blocks, those that have a partner of another label in the other block by size and sketch."""
    b1, b2 = pdf["b1"].iloc[0], pdf["b2"].iloc[0]
    rows = pdf.reset_index(drop=True)
    left, right = (np.flatnonzero(rows["block"].to_numpy() == b) for b in (b1, b2))
    keep = np.zeros(len(rows), bool)
    if len(left) and len(right):
        sketch = np.array(rows["sketch"].tolist(), np.int16)
        size, label = rows["n"].to_numpy(np.int64), rows["label"].to_numpy()
        for i in left.tolist():
            lo, hi = np.minimum(size[i], size[right]), np.maximum(size[i], size[right])
            near = right[(100 * lo >= percent * hi) & (label[right] != label[i])]
            if len(near):
                apart = np.abs(sketch[near] - sketch[i]).sum(1, dtype=np.int64)
                hit = near[apart * (100 + percent) <= (100 - percent) * (size[near] + size[i])]
                if len(hit):
                    keep[i] = True
                    keep[hit] = True
    return rows.loc[keep, ["unit", "b1", "b2", "block", "node", "n", "label"]]


def placed_in_blocks(rest: DataFrame, percent: int) -> DataFrame:
    """unit, block, one (the component, if the block holds sets of one only), cls (of sizes), node, n, label. rest: unit, node, n, label. A
    block holds sets of sizes within a step of the threshold, of one component or of several small ones."""
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.0 / percent) * 1.0001))
    rest = rest.withColumn("cls", step.cast("int"))
    per = rest.groupBy("unit", "cls", "label").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS))
    per = per.withColumn("parts", parts).withColumn("big", (F.col("members") >= BLOCK) | (F.col("grams") >= BLOCK_GRAMS))
    small = per.filter("NOT big").groupBy("unit", "cls").agg(F.greatest(F.ceil(F.sum("members") / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).alias("packs"))
    placed = rest.join(per.select("unit", "cls", "label", "parts", "big"), ["unit", "cls", "label"]).join(small, ["unit", "cls"], "left")
    block = F.when(F.col("big"), F.xxhash64(F.lit(1), "cls", "label", F.pmod(F.xxhash64("node"), "parts"))).otherwise(F.xxhash64(F.lit(2), "cls", F.pmod(F.xxhash64("node"), "packs")))
    return placed.withColumn("block", block).withColumn("one", F.when(F.col("big"), F.col("label"))).select("unit", "block", "one", "cls", "node", "n", "label")


def block_tiles(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """unit, b1, b2, block, node, n, label: pairs of blocks of each unit, with the sets in them that may have a link to a set of
    another component on the other side. A block meets those of its own sizes and the next."""
    blocks = placed.select("unit", "block", "one", "cls").distinct()
    x, y = (blocks.select("unit", F.col("block").alias(f"b{k}"), F.col("one").alias(f"o{k}"), F.col("cls").alias(f"k{k}")) for k in (1, 2))
    meets = x.join(y, "unit").filter("b1 <= b2 AND abs(k1 - k2) <= 1 AND NOT coalesce(o1 = o2, false)").select("unit", "b1", "b2")
    either = meets.withColumn("block", F.explode(F.array_distinct(F.array("b1", "b2"))))
    tiles = placed.select("unit", "block", "node", "n", "label").join(either, ["unit", "block"]).join(nodes.select("node", "sketch"), "node")
    return tiles.groupBy("unit", "b1", "b2").applyInPandas(lambda pdf: block_hints(pdf, percent), "unit bigint, b1 bigint, b2 bigint, block bigint, node bigint, n bigint, label bigint")


def compared_in_blocks(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components in pairs of blocks."""
    whole = sets.select("node", F.concat(*(f"g{k}" for k in range(PARTS))).alias("grams"))
    return tiles.join(whole, "node").groupBy("unit", "b1", "b2").applyInPandas(lambda pdf: block_links(pdf, percent), "a bigint, b bigint")


def sharing(spark: SparkSession, keyed: DataFrame) -> tuple[DataFrame, list[str]]:
    """key, c1, n, company of the keys that two sets or more have, a slice of the key space after another, and where the parts lie.
    keyed: c1, n, keys0, keys1, .. of every row; rows of equal sets, which have the same c1, are one in the result."""
    paths = []
    for k in range(SLICES):
        each = keyed.select("c1", "n", F.explode(f"keys{k}").alias("key"))
        many = each.groupBy("key").agg(F.count("*").alias("company"), F.min("c1").alias("lo"), F.max("c1").alias("hi")).filter("lo < hi")
        many, many_path = written(spark, many.select("key", "company"), "jaccard-company")
        part, path = written(spark, each.join(many, "key").distinct(), "jaccard-groups")
        remove(spark, many_path)
        paths.append(path)
    return spark.read.schema(part.schema).parquet(*paths), paths


def link_classes(spark: SparkSession, keyed: DataFrame, keyed_path: str, classes: DataFrame, texts: DataFrame, n: int, percent: int, family: int) -> DataFrame | None:
    """node, label: components of classes (c1, node, n, sketch, h1, h2); None where no two share a key. keyed: c1, n, keys by slice,
    a view of the table at keyed_path, which goes once it has been read. texts: id, text, h1, h2."""
    groups, groups_paths = sharing(spark, keyed)
    remove(spark, keyed_path)
    if groups.isEmpty():
        remove(spark, *groups_paths)
        return None
    central = groups.groupBy("c1").agg(F.sum("company").alias("weight"))
    nodes, nodes_path = written(spark, classes.join(central, "c1"), "jaccard-nodes")
    members, members_path = written(spark, groups.select("key", "c1").join(nodes.select("c1", "node", "n", "weight"), "c1").drop("c1"), "jaccard-members")
    remove(spark, *groups_paths)
    free(spark)

    # each member with the most central one of its group
    hubs, hubs_path = written(spark, members.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")), "jaccard-hubs")
    met, met_path = written(spark, members.join(hubs, "key").filter("node <> hub").groupBy("node", "n", "hub", "hub_n").agg(F.min(F.col("key") % 2 != 0).alias("odd")), "jaccard-met")
    near = met.filter(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    pairs = near.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs, pairs_path = written(spark, possible(pairs, nodes, percent), "jaccard-pairs")
    there = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets, sets_path = written(spark, fragment_pass(texts, nodes.join(there, "node").select("node", F.lit(False).alias("known"), "h1", "h2"), n), "jaccard-sets")
    free(spark)
    links = linked(spark, pairs, sets, percent)
    labels, labels_path = written(spark, components(spark, links), "jaccard-labels")

    # families of groups that hold more than one component
    families = components(spark, met.filter("NOT odd").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("label", "unit")
    told = nodes.join(labels, "node", "left").join(families, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("unit", "node").alias("unit"))
    told, told_path = written(spark, told, "jaccard-told")
    # tables of their own, so that the join can be split and is done once; rows keep the size of their unit
    open_units = told.groupBy("unit").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    open_units, units_path = written(spark, open_units.select("unit", "size"), "jaccard-units")
    opened, opened_path = written(spark, told.join(open_units, "unit").select("unit", "size", "node", "n", "label"), "jaccard-open")
    rest = opened.filter(F.col("size") <= family)
    wide = opened.filter(F.col("size") > family).select("node", "n", "label")
    # odd keys join what has little in common; their groups are units of their own, as are all groups of too large a family
    inner = members.filter("key % 2 <> 0").select("key", "node").join(told.select("node", "n", "label"), "node")
    inner = inner.unionByName(members.filter("key % 2 = 0").select("key", "node").join(wide, "node"))
    inner, inner_path = written(spark, inner, "jaccard-inner")
    gone = [nodes_path, pairs_path, sets_path]
    if not inner.isEmpty():
        # groups of the same members are one unit
        unit = F.xxhash64(F.lit(3), F.count("*"), F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(5), "node")))
        mixed = inner.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), unit.alias("unit")).filter("lo < hi")
        mixed, mixed_path = written(spark, mixed.groupBy("unit").agg(F.min_by(F.struct("key", "size"), "key").alias("k")).select("unit", "k.key", "k.size"), "jaccard-mixed")
        gone.append(mixed_path)
        rest = rest.unionByName(inner.join(mixed, "key").select("unit", "size", "node", "n", "label"))
    rest, rest_path = written(spark, rest, "jaccard-rest")
    remove(spark, members_path, met_path, told_path, units_path, opened_path, inner_path, hubs_path)
    gone.append(rest_path)
    if not rest.isEmpty():
        # units of a few sets: their pairs, which are fewer than FEW times the rows; larger ones: blocks
        few = rest.filter(F.col("size") <= FEW).drop("size").join(nodes.select("node", "sketch"), "node")
        packs = few.withColumn("pack", F.pmod(F.xxhash64("unit"), F.lit(max(1, rest.count() // 4096))))
        small = packs.groupBy("pack").applyInPandas(lambda pdf: pairs_in_units(pdf, percent), "a bigint, b bigint").distinct()
        small, small_path = written(spark, small.join(pairs, ["a", "b"], "left_anti"), "jaccard-pairs")
        placed, placed_path = written(spark, placed_in_blocks(rest.filter(F.col("size") > FEW).drop("size"), percent), "jaccard-placed")
        large, large_path = written(spark, block_tiles(placed, nodes, percent), "jaccard-tiles")
        want = [f.select(F.col(c).alias("node")) for f, c in ((small, "a"), (small, "b"), (large, "node"))]
        # sets of blocks are made again even where they are known: the table that blocks are read from stays small
        have = sets.select("node", F.lit(True).alias("has"))
        want = want[0].withColumn("tile", F.lit(False)).unionByName(want[1].withColumn("tile", F.lit(False))).unionByName(want[2].withColumn("tile", F.lit(True)))
        want = want.groupBy("node").agg(F.max("tile").alias("tile")).join(have, "node", "left").withColumn("known", F.coalesce("has", F.lit(False))).filter("tile OR NOT known")
        more_sets, more_path = written(spark, fragment_pass(texts, nodes.join(want, "node").select("node", "known", "h1", "h2"), n), "jaccard-sets")
        more = linked(spark, small, sets.unionByName(more_sets.filter("NOT known")), percent)
        gone += [small_path, placed_path, large_path, more_path]
        if not large.isEmpty():  # a job of its own: what the first has shuffled is gone by then
            crossed, _ = written(spark, compared_in_blocks(large, more_sets, percent), "jaccard-links")
            more = more.unionByName(crossed)
        if not more.isEmpty():
            remove(spark, labels_path)
            labels, _ = written(spark, components(spark, links.unionByName(more)), "jaccard-labels")
    remove(spark, *gone)
    free(spark)
    return labels


def classed(spark: SparkSession, texts: DataFrame, n: int, percent: int, family: int) -> DataFrame:
    """id, h1, h2, n, component (the smallest id in reach; LAST: there is none but null) and label (of the component) of each
    row; the last two are null where the set is empty."""
    rows, rows_path = written(spark, set_pass(texts, n, percent), "jaccard-rows")
    number = F.coalesce(F.col("id").cast("long"), F.lit(LAST))
    slices = [f"keys{k}" for k in range(SLICES)]
    least = F.min(F.struct(number.alias("rep"), "h1", "h2")).alias("r")
    classes = rows.filter("n > 0").groupBy("c1", "c2").agg(least, F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("c1", "c2", "r.*", "n", "sketch")
    classes, classes_path = written(spark, classes, "jaccard-classes")
    keyed = rows.select("c1", "n", *slices)
    rows, _ = written(spark, rows.select("id", "h1", "h2", "c1", "c2", "n"), "jaccard-ids")
    # a class is a node by its smallest id; where different texts share that, by a hash
    twice = classes.groupBy("rep").count().filter("count > 1").select("rep", F.lit(True).alias("twice"))
    classes = classes.withColumn("node", F.col("rep")) if twice.isEmpty() else classes.join(twice, "rep", "left").withColumn("node", F.when(F.col("twice"), F.xxhash64("rep", "c1", "c2")).otherwise(F.col("rep"))).drop("twice")
    narrow, narrow_path = written(spark, classes.select("c1", "c2", "rep", "h1", "h2", "node", "n", "sketch"), "jaccard-nodes")
    remove(spark, classes_path)
    labels = link_classes(spark, keyed, rows_path, narrow.select("c1", "node", "n", "sketch", "h1", "h2"), texts, n, percent, family)
    found = narrow.select("c1", "c2", "rep", "node")
    if labels is None:
        found = found.withColumn("component", F.col("rep")).withColumn("label", F.col("node"))
    else:
        tied = found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least, _ = written(spark, tied.groupBy("label").agg(F.min("rep").alias("component")), "jaccard-least")
        found = tied.join(least, "label")
    found, _ = written(spark, found.select("c1", "c2", "component", "label"), "jaccard-components")
    remove(spark, narrow_path)
    return rows.join(found, ["c1", "c2"], "left").select("id", "h1", "h2", "n", "component", "label")


def near_duplicates(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", family: int = 4_000) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id in reach) per row of df."""
    out = classed(df.sparkSession, hashed(df, id_col, text_col), n, percent, family)
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("component") == LAST, F.lit(None)).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def one_of_each_group(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", family: int = 4_000) -> DataFrame:
    """One row of df, with all its columns, of each component: that with the smallest id (null last), of several such the one
    whose text, and then whose row, has the least hash. Texts without n-grams are in no component, and all of them stay."""
    spark = df.sparkSession
    found, found_path = written(spark, classed(spark, hashed(df, id_col, text_col), n, percent, family).filter("n > 0").withColumn("number", F.coalesce(F.col("id").cast("long"), F.lit(LAST))), "jaccard-found")
    stays, stays_path = written(spark, found.groupBy("label").agg(F.min(F.struct("number", "h1", "h2")).alias("first")), "jaccard-stays")
    gone = found.join(stays, "label").filter(F.struct("number", "h1", "h2") != F.col("first")).select("id", "h1", "h2").distinct()
    gone, _ = written(spark, gone, "jaccard-gone")
    firsts = stays.select("first.*")
    again, _ = written(spark, found.groupBy("id", "number", "h1", "h2").count().filter("count > 1").join(firsts, ["number", "h1", "h2"]).select("id", "h1", "h2"), "jaccard-again")
    remove(spark, found_path, stays_path)

    def meets(keys: DataFrame, kind: str, to: DataFrame) -> DataFrame:
        k = keys.select(F.col("id").alias("k_id"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
        return to.join(k, F.col("row_id").eqNullSafe(F.col("k_id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), kind)

    # rows travel as one column, so their names cannot clash
    packed = hashed(df.select(F.struct(*df.columns).alias("row")), "row." + quoted(id_col), "row." + quoted(text_col), "row").drop("text").withColumnRenamed("id", "row_id")
    kept = meets(gone, "left_anti", packed)
    if not again.isEmpty():
        one = meets(again, "left_semi", kept).groupBy("row_id", "h1", "h2").agg(F.min_by("row", F.xxhash64(F.col("row").cast("string"))).alias("row"))
        kept = meets(again, "left_anti", kept).select("row").unionByName(one.select("row"))
    return kept.select("row.*")
