"""Near duplicates by SimHash with deletion-variant signatures (operator 12).

A text's fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 values of its word shingles. Two fingerprints
are linked at `distance` (2 or 3) or fewer differing bits. Instead of one segment more than bits may differ, of which one must be equal, a
fingerprint is cut into two halves, of which one differs by at most one bit. Each half is indexed under its 32 one-wildcard variants (the half with
one bit masked out, and which): halves that differ in one bit meet in the variant that masks it, equal ones in all. Equality of variants
brings candidates together, and the differing bits of the whole are counted before anything is a link.

A variant that more than SMALL different fingerprints share isn't compared as a whole: there the half left over must differ by at most
`distance` bits too, so it is cut in the same way, and once more. A variant of the third level leaves eleven bits open, so no group
is ever larger than 2048 fingerprints, however many share the first half. Groups are counted first (map-side combined) in a table of
their own, to which fingerprints are joined; groups of two need no join. Equal fingerprints are one from the start. Only links are
given out, never pairs. What is linked becomes one component by star steps over links (components.py).

Defined results: a text of fewer words than a shingle is one shingle; a null text, and one without words, has fingerprint zero, linked like
any other; whole texts are read; an id that repeats stands for all its rows' texts; a row without id is linked but is nobody's least
id (null where no row of a component has one); repeated rows give repeated results; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import free, map_arrow, remove, signed, written
from strandlake.llm.components import components

SMALL = 256  # fingerprints of a group that are compared as they are
PART = 1 << 15  # hashes whose bits are counted together
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = 64


def shingle_hashes(text: str | None, n: int, seed: int) -> np.ndarray:
    """XXH64 of each n consecutive words, A-Z lower-cased and joined by a blank; of all words where they are fewer; none without words."""
    ws = text.encode("utf-8").translate(LOWER).split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    stop = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    start = np.append(0, stop[:-1] + 1)
    k = min(n, len(ws))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[: len(ws) - k + 1].tolist(), stop[k - 1 :].tolist())), np.uint64, len(ws) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), PART):
        ones += np.unpackbits(hashes[k : k + PART].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                fps = np.fromiter((fingerprint(shingle_hashes(t, n, seed)) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(fps))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp bigint")


def variants(df: DataFrame, width: int, key: str) -> DataFrame:
    """Rows of df (with `rest`, width bits) for each half and each masked bit: key (half, bit and what is left of it), and rest, the other half."""
    half = width // 2
    low, high = F.expr(f"rest & {(1 << half) - 1}L"), F.expr(f"shiftrightunsigned(rest, {half}) & {(1 << half) - 1}L")
    cut = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("side"), low.alias("own"), high.alias("other")), F.struct(F.lit(1).cast("long").alias("side"), high.alias("own"), low.alias("other"))))
    x = df.withColumn("_h", cut).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(half - 1))))
    made = F.expr(f"_h.own & ~shiftleft(1L, _b) | shiftleft(CAST(_b AS BIGINT), {half}) | shiftleft(_h.side, {half + 6})")
    return x.withColumn(key, made).withColumn("rest", F.col("_h.other")).drop("_h", "_b")


def linked_in(groups: DataFrame, distance: int) -> DataFrame:
    """a, b: links within each array `fps` of a group, whose size is bounded."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                x = np.unique(fps.values.to_numpy()).view(np.uint64)
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= distance)
                a.append(x[i[i < j]])
                b.append(x[j[i < j]])
            if a:
                ends = np.unique(np.stack([signed(np.concatenate(a)), signed(np.concatenate(b))], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return map_arrow(groups.select("fps"), run, "a bigint, b bigint")


def links(fps: DataFrame, distance: int = 2, small: int = SMALL) -> DataFrame:
    """a, b: all pairs of the different fingerprints fp of a written table that differ by at most `distance` bits; a pair may come
    several times. Tables of the levels stay in the shared folder until it is cleared, except those that are read again here."""
    if distance not in (2, 3):
        raise ValueError("two halves, of which one differs by at most one bit, need a distance of 2 or 3")
    spark, found, by, width = fps.sparkSession, [], [], BITS
    rows = fps.select("fp", F.col("fp").alias("rest"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    while True:
        by.append(f"k{len(by) + 1}")
        keyed, last = variants(rows, width, by[-1]), len(by) == 3
        sizes, _ = written(spark, keyed.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"), "simhash-sizes")
        found.append(sizes.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).filter(near("a", "b")))
        small_ones = sizes.filter("n > 2" if last else f"n BETWEEN 3 AND {small}").select(*by)
        groups = keyed.join(small_ones, by).groupBy(*by).agg(F.collect_list("fp").alias("fps"))
        pairs, _ = written(spark, linked_in(groups, distance).distinct(), "simhash-pairs")
        found.append(pairs)
        large = sizes.filter(f"n > {small}").select(*by)
        if last or large.isEmpty():
            out = found[0]
            for x in found[1:]:
                out = out.unionByName(x)
            return out
        rows, _ = written(spark, keyed.join(large, by).select("fp", "rest", *by), "simhash-large")
        width //= 2
        free(spark)


def near_duplicates(df: DataFrame, distance: int = 2, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id (the least id in reach over links) of every row."""
    spark = df.sparkSession
    rows, _ = written(spark, fingerprints(df, n, seed, id_col, text_col), "simhash-rows")
    each, each_path = written(spark, rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-each")
    labels, labels_path = written(spark, components(spark, links(each, distance).distinct()), "simhash-labels")
    own = each.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    own, own_path = written(spark, own, "simhash-own")
    best, best_path = written(spark, own.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-best")
    told, _ = written(spark, own.join(best, "label").select("fp", "component_id"), "simhash-told")
    remove(spark, each_path, labels_path, own_path, best_path)
    free(spark)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(told, "fp").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, distance: int = 2, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose id is the least of their component."""
    told = near_duplicates(df, distance, n, seed, id_col, text_col)
    stay, _ = written(df.sparkSession, told.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("stay")).distinct(), "simhash-stay")
    packed = df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"), F.col(id_col).alias("own"))
    return packed.join(stay, F.col("own") == F.col("stay"), "left_semi").select("row.*")
