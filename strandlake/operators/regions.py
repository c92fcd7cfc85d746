"""Interval operators on (chrom, beg, end), closed on both ends.

An interval join has no equi-key. Intervals get a level by their length: the bins of a level are as wide as its longest
interval, so an interval lies in two bins of its own level, or of a higher one, at most. A pair meets on the level of the longer
of the two, in the bin where the later one begins. However lengths are mixed, a row is sent twice for each level that the
data have, and not once for each short bin under a long interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_BITS, LEVEL_BITS = 4, 4  # width of the narrowest bins, and how much wider those of the next level are


def level_of(beg: Column, end: Column) -> Column:
    """0 for up to 2**LEAST_BITS positions, one more for each LEVEL_BITS that the length needs."""
    bits = F.length(F.bin(F.greatest(F.lit(1), end - beg + 1).cast("long") - 1))
    return F.greatest(F.lit(0), F.ceil((bits - LEAST_BITS) / LEVEL_BITS)).cast("int")


def levels_in(df: DataFrame, beg: str, end: str) -> set[int]:
    """Levels that occur: a handful of numbers, whatever the size of the table."""
    found = df.filter(F.col(beg) <= F.col(end)).agg(F.collect_set(level_of(F.col(beg), F.col(end)))).first()[0]
    return set(found)


def placed(df: DataFrame, beg: str, end: str, levels: list[int], tag: str) -> DataFrame:
    """A row for each bin of each level from the interval's own upwards: _own, _level, _bin, and _first where it begins in that bin."""
    own = level_of(F.col(beg), F.col(end))
    bits = lambda k: LEAST_BITS + k * LEVEL_BITS

    def cells_of(k: int) -> Column:
        bins = F.sequence(F.shiftright(F.col(beg).cast("long"), bits(k)), F.shiftright(F.col(end).cast("long"), bits(k)))
        return F.when(own <= k, F.transform(bins, lambda x: F.struct(F.lit(k).alias("level"), x.alias("bin")))).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

    cells = [cells_of(k) for k in levels]
    out = df.withColumn(f"_own_{tag}", own).withColumn("_cell", F.explode(F.flatten(F.array(*cells)) if len(cells) > 1 else cells[0]))
    out = out.withColumn(f"_level_{tag}", F.col("_cell.level")).withColumn(f"_bin_{tag}", F.col("_cell.bin")).drop("_cell")
    first = F.coalesce(*(F.when(F.col(f"_level_{tag}") == k, F.shiftright(F.col(beg).cast("long"), bits(k))) for k in levels))
    return out.withColumn(f"_first_{tag}", F.col(f"_bin_{tag}") == first)


def dealt(df: DataFrame, parts: int | None, *cols: str) -> DataFrame:
    """df by columns in a number of partitions that stays, however small they are; as it is, if none is given."""
    return df if parts is None else df.repartition(parts, *cols)


def parts_of(spark: SparkSession) -> int:
    """Partitions for a join whose pairs are many more than its rows: by the rows' size, Spark would put it into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], a_iv: tuple[str, str], b_iv: tuple[str, str], how: str = "inner", residual: Column | None = None, parts: int | None = None, levels: set[int] | None = None) -> DataFrame:
    """Pairs of rows of equal keys whose intervals overlap. how: inner, left, left_semi or left_anti; keys: (column of a,
    column of b). Columns of the two sides must differ in name. Intervals that end before they begin, or have no end, overlap
    with nothing; left and left_anti return such rows of a once, like all others without a partner. parts: in how many partitions rows are dealt
    for an inner join, such as parts_of gives; without it, Spark decides by the size of the rows. levels: those that may occur, where they are known."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    (ab, ae), (bb, be) = a_iv, b_iv
    if residual is None and how in ("left_semi", "left_anti"):
        hit = overlaps_any(a, b, keys, a_iv, b_iv, "_hit")
        return hit.filter(F.col("_hit") if how == "left_semi" else ~F.col("_hit")).drop("_hit")
    levels = sorted(levels_in(a, *a_iv) | levels_in(b, *b_iv) if levels is None else levels) or [0]
    proper = F.coalesce(F.col(ab) <= F.col(ae), F.lit(False))
    right = placed(b.filter(F.col(bb) <= F.col(be)), bb, be, levels, "b")
    cond = (F.col("_level_a") == F.col("_level_b")) & (F.col("_bin_a") == F.col("_bin_b"))
    for x, y in keys:
        cond = cond & (a[x] == b[y])
    cond = cond & (F.col(ab) <= F.col(be)) & (F.col(bb) <= F.col(ae))
    if len(levels) > 1:  # the level of the longer one
        cond = cond & ((F.col("_own_a") == F.col("_level_a")) | (F.col("_own_b") == F.col("_level_b")))
    if residual is not None:
        cond = cond & residual
    once = cond & (F.col("_first_a") | F.col("_first_b"))  # in the bin where the later one begins
    marks = [f"{m}_{t}" for m in ("_own", "_level", "_bin", "_first") for t in "ab"]
    if how == "inner":
        left = dealt(placed(a.filter(proper), ab, ae, levels, "a"), parts, "_level_a", "_bin_a", *(x for x, _ in keys))
        return left.join(dealt(right, parts, "_level_b", "_bin_b", *(y for _, y in keys)), once).drop(*marks)
    # rows of a that lie in one bin in all meet all their partners there; the others are numbered, each in one place only
    top = levels[-1]
    bits = LEAST_BITS + top * LEVEL_BITS
    one = level_of(F.col(ab), F.col(ae)) == top
    one = one & (F.shiftright(F.col(ab).cast("long"), bits) == F.shiftright(F.col(ae).cast("long"), bits))
    left = placed(a.filter(proper & one), ab, ae, [top], "a")
    many = placed(a.filter(proper & ~one).withColumn("_row", F.monotonically_increasing_id()), ab, ae, levels, "a")
    if how == "left_semi":
        hit = left.join(right, cond, how).select(*a.columns)
        return hit.unionByName(many.join(right, cond, how).dropDuplicates(["_row"]).select(*a.columns))
    # one join of all bins; of a row without a partner in any of them, one copy is left
    met = many.join(right, once, "left")
    per = Window.partitionBy("_row")
    met = met.withColumn("_n", F.count("_bin_b").over(per)).withColumn("_k", F.row_number().over(per.orderBy("_level_a", "_bin_a")))
    if how == "left_anti":
        out = left.join(right, cond, how).select(*a.columns)
        out = out.unionByName(met.filter("_n = 0 AND _k = 1").select(*a.columns))
        return out.unionByName(a.filter(~proper))
    out = left.join(right, cond, how).drop(*marks)
    out = out.unionByName(met.filter("_bin_b IS NOT NULL OR _n = 0 AND _k = 1").drop("_row", "_n", "_k", *marks))
    return out.unionByName(a.filter(~proper), allowMissingColumns=True)


TILE = 256  # positions of a tile of running values, unless told otherwise


def running(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], a_at: str, b_at: str, strict: bool, values: dict[str, tuple[Column, str]], tile: int) -> DataFrame:
    """Rows of a with, for each value (a column of b, and "max" or "sum"), that of b's rows at positions up to a's own (strict: before it).

    Rows of both are sorted together by tiles of positions; what lies before a tile comes in as a row of its own at its beginning, from
    one row a tile. No pairs are formed, and no window holds more than a key's tile. Rows of a without a position get what b gives to
    nobody: null."""
    fold = {"max": F.max, "sum": F.sum}
    names = [y for _, y in keys]
    number = lambda c: F.floor(F.col(c) / tile)
    row = F.struct(*(F.col(f"`{c}`") for c in a.columns))
    left = a.select(*(F.col(x).alias(f"_k{i}") for i, (x, _) in enumerate(keys)), number(a_at).alias("_tile"), F.col(a_at).cast("long").alias("_at"), F.lit(0 if strict else 2).alias("_side"), row.alias("_row"))
    each = b.select(*(F.col(y).alias(f"_k{i}") for i, y in enumerate(names)), number(b_at).alias("_tile"), F.col(b_at).cast("long").alias("_at"), *(v.alias(f"_v{i}") for i, (v, _) in enumerate(values.values()))).filter("_at IS NOT NULL")
    ks, vs = [f"_k{i}" for i in range(len(keys))], [f"_v{i}" for i in range(len(values))]
    kinds = [k for _, k in values.values()]
    own = each.groupBy(*ks, "_tile").agg(*(fold[k](v).alias(v) for v, k in zip(vs, kinds)))
    all_tiles = own.unionByName(left.select(*ks, "_tile").distinct(), allowMissingColumns=True).groupBy(*ks, "_tile").agg(*(fold[k](v).alias(v) for v, k in zip(vs, kinds)))
    before = Window.partitionBy(*ks).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)  # a row a tile
    carried = all_tiles.select(*ks, "_tile", *(fold[k](v).over(before).alias(v) for v, k in zip(vs, kinds))).withColumn("_at", F.col("_tile") * tile).withColumn("_side", F.lit(-1))
    both = left.unionByName(each.withColumn("_side", F.lit(1)), allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*ks, "_tile").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.select("_row", *(fold[k](v).over(w).alias(n) for n, v, k in zip(values, vs, kinds))).filter("_row IS NOT NULL")
    return out.select("_row.*", *values)


def overlaps_any(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], a_iv: tuple[str, str], b_iv: tuple[str, str], name: str = "hit", tile: int = TILE) -> DataFrame:
    """Rows of a with whether any interval of b overlaps theirs: of b's intervals that begin at or before its end, the greatest end decides."""
    (ab, ae), (bb, be) = a_iv, b_iv
    x = running(a, b.filter(F.col(bb) <= F.col(be)), keys, ae, bb, False, {"_reach": (F.col(be), "max")}, tile)
    return x.withColumn(name, F.coalesce((F.col(ab) <= F.col(ae)) & (F.col("_reach") >= F.col(ab)), F.lit(False))).drop("_reach")


def overlap_totals(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], a_iv: tuple[str, str], b_iv: tuple[str, str], count: str = "n", sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, tile: int = TILE) -> DataFrame:
    """Rows of a with how many intervals of b overlap theirs, and sums and least values of columns of b over these (null where there are none).

    Counts and sums are differences: what begins at or before my end, less what ends before my beginning, both running sums. Least values need
    pairs; those are of different intervals only, with b's values put together by interval first. Columns of a and b must differ in name."""
    (ab, ae), (bb, be) = a_iv, b_iv
    sums, least = sums or {}, least or {}
    right = b.filter(F.col(bb) <= F.col(be))
    values = {"_c": (F.lit(1).cast("long"), "sum")} | {f"_s{i}": (v, "sum") for i, v in enumerate(sums.values())} | {f"_f{i}": (v.isNotNull().cast("long"), "sum") for i, v in enumerate(sums.values())}
    x = running(a, right, keys, ae, bb, False, {f"{n}a": v for n, v in values.items()}, tile)
    x = running(x, right, keys, ab, be, True, {f"{n}b": v for n, v in values.items()}, tile)
    proper = F.coalesce(F.col(ab) <= F.col(ae), F.lit(False))
    diff = lambda n: F.when(proper, F.coalesce(F.col(f"{n}a"), F.lit(0)) - F.coalesce(F.col(f"{n}b"), F.lit(0))).otherwise(0)
    x = x.withColumn(count, diff("_c")).withColumns({n: F.when(diff(f"_f{i}") > 0, diff(f"_s{i}")) for i, n in enumerate(sums)})
    x = x.drop(*(f"{n}{t}" for n in values for t in "ab"))
    if not least:
        return x
    few = right.groupBy(*(y for _, y in keys), bb, be).agg(*(F.min(v).alias(f"_m{i}") for i, v in enumerate(least.values())))
    mine = a.filter(proper).select(*(F.col(k) for k, _ in keys), ab, ae).distinct()
    met = overlap_join(mine, few, keys, a_iv, b_iv).groupBy(*(k for k, _ in keys), ab, ae).agg(*(F.min(f"_m{i}").alias(n) for i, n in enumerate(least)))
    met = met.select(*(F.col(c).alias(f"_j{i}") for i, c in enumerate([*(k for k, _ in keys), ab, ae])), *least)
    same = F.lit(True)
    for i, c in enumerate([*(k for k, _ in keys), ab, ae]):
        same = same & (F.col(c) == F.col(f"_j{i}"))
    return x.join(met, same, "left").drop(*(f"_j{i}" for i in range(len(keys) + 2)))


def merge_intervals(df: DataFrame, keys: list[str], beg: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of intervals that share a position, or lie at most `gap` apart; touching ends merge, adjacent ones do not."""
    w = Window.partitionBy(*keys).orderBy(beg, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(before + gap >= F.col(beg), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_isle", isle).groupBy(*keys, "_isle").agg(F.min(beg).alias(beg), F.max(end).alias(end), F.count("*").alias("n")).drop("_isle")


def islands(df: DataFrame, keys: list[str], order: list[str], label: Column, pos: str, gap: int | None = None) -> DataFrame:
    """Runs of consecutive rows of equal label (null-safe), broken also by gaps of more than `gap`: first and last position
    and row count of each."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = ~label.eqNullSafe(F.lag(label).over(w)) | F.lag(pos).over(w).isNull()
    if gap is not None:
        new = new | (F.col(pos) - F.lag(pos).over(w) > gap)
    x = df.withColumn("label", label).withColumn("_new", new).withColumn("run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "run", "label").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"))


def as_of(a: DataFrame, b: DataFrame, keys: list[str], at: str, value: str, direction: str = "backward") -> DataFrame:
    """Rows of a with the value of b at the nearest position not after (backward) or not before (forward) their own. One sort
    of both tables together; no pairs are formed."""
    x = a.select("*", F.lit(None).cast(dict(b.dtypes)[value]).alias("_v"), F.lit(None).cast(dict(b.dtypes)[at]).alias("_at"), F.lit(1).alias("_side"))
    y = b.select(*keys, at, F.col(value).alias("_v"), F.col(at).alias("_at"), F.lit(0).alias("_side"))
    both = x.unionByName(y, allowMissingColumns=True)
    if direction == "backward":
        w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.last(F.when(F.col("_side") == 0, F.struct("_v", "_at")), ignorenulls=True).over(w)
    out = both.withColumn("_p", pick).filter("_side = 1")
    return out.select(*a.columns, F.col("_p._v").alias(f"{value}_{direction}"), F.col("_p._at").alias(f"{at}_{direction}"))


def interpolate(a: DataFrame, b: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Linear interpolation of b's value at a's positions; beyond the ends the nearest value holds."""
    x = as_of(as_of(a, b, keys, at, value, "backward"), b, keys, at, value, "forward")
    v0, v1, p0, p1 = (F.col(c) for c in (f"{value}_backward", f"{value}_forward", f"{at}_backward", f"{at}_forward"))
    y = F.when(v0.isNull(), v1).when(v1.isNull() | (p1 == p0), v0).otherwise(v0 + (v1 - v0) * (F.col(at) - p0) / (p1 - p0))
    return x.withColumn(f"{value}_at", y).drop(*(f"{c}_{d}" for c in (value, at) for d in ("backward", "forward")))


def nearest_distance(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """dist_rev, dist_fwd, dist_nearest: to the closest different position on either side; rows at one position share them."""
    w = Window.partitionBy(*keys).orderBy(at)
    places = df.select(*keys, at).distinct().withColumn("dist_rev", F.col(at) - F.lag(at).over(w)).withColumn("dist_fwd", F.lead(at).over(w) - F.col(at))
    return df.join(places.withColumn("dist_nearest", F.least("dist_rev", "dist_fwd")), [*keys, at])


def near_any(df: DataFrame, keys: list[str], at: str, is_mark: Column, within: int) -> DataFrame:
    """Adds near_mark: whether a marked row (other than itself) lies at most `within` away."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-within, within)
    n = F.sum(is_mark.cast("int")).over(w) - is_mark.cast("int")
    return df.withColumn("near_mark", n > 0)


def best_of_cluster(df: DataFrame, keys: list[str], at: str, gap: int, *best: Column) -> DataFrame:
    """Rows less than `gap` from the one before form a cluster, of which the first by `best` stays."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True))
    x = df.withColumn("_new", new.cast("int")).withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_cluster").orderBy(*best))).filter("_r = 1").drop("_new", "_cluster", "_r")


def cluster_size(df: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """Adds cluster_size: the greatest number of rows in any window of `width` positions that begins at a row and holds this one."""
    ahead = Window.partitionBy(*keys).orderBy(at).rangeBetween(0, width - 1)
    behind = Window.partitionBy(*keys).orderBy(at).rangeBetween(-(width - 1), 0)
    return df.withColumn("_n", F.count("*").over(ahead)).withColumn("cluster_size", F.max("_n").over(behind)).drop("_n")
