"""Target-distribution importance resampling over hashed n-grams (operator 11).

Features are runs of 1 to 2 consecutive words. They are never made as strings: a vectorised byte automaton reads the UTF-8 buffer of an
Arrow column. A lookup table lower-cases A-Z and turns every other byte that is no part of a word to 0; word boundaries are where that
being 0 changes (or a text begins); and a table-driven CRC advances over all words at once, a byte of each in a step, longest words
first so that those still running are a prefix. A run of two words starts from the register that the first has left behind, moved on by
a blank. Texts longer than STEP bytes go through in pieces that end between words, the register of the last word carried over, so memory
is bounded by STEP and not by the text; words above LONG bytes are read by zlib, one by one.

Two passes: bucket counts of all rows and of the target (summed by task, then by bucket; `buckets` rows come to the driver, whatever
the input), then the weight of each row from the gains of its buckets. Ranks are those of a range-partitioned table: place in the
partition plus the sizes of the partitions before it, so neither a window nor a task holds all rows.

Defined results: a null or empty text, or one without words, has no feature and weight 0; whole texts are read, whatever their length; a
row without id counts in the bucket counts, and has no score and no rank; equal scores are ranked by ascending id; repeated rows are
rows of their own with neighbouring ranks in any order; an empty table gives an empty one, an empty target one without counts; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import map_arrow, quoted, remove, written

STEP = 1 << 22  # bytes of text that are looked at together
LONG = 64  # bytes of a word above which it is no part of the common steps


def crc_table() -> np.ndarray:
    """The 256 registers of the reflected polynomial 0xEDB88320, by eight shifts of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def byte_classes() -> np.ndarray:
    """By byte: what it is in a word, A-Z lower-cased, or 0 where it parts words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[:48] = t[58:65] = t[91:97] = t[123:128] = 0
    return t


CRC, CLASS, START = crc_table(), byte_classes(), np.uint32(0xFFFFFFFF)


def shifted(reg: np.ndarray, byte: np.ndarray | np.uint8) -> np.ndarray:
    return CRC[(reg ^ byte) & np.uint32(255)] ^ reg >> np.uint32(8)


def advanced(reg: np.ndarray, x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers after the words x[start : start + size], all at once."""
    out = reg.copy()
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    first = int((size > LONG).sum())
    for w in order[:first].tolist():
        out[w] = zlib.crc32(x[start[w] : start[w] + size[w]], int(reg[w] ^ START)) ^ 0xFFFFFFFF
    order = order[first:]
    at, r = start[order], reg[order]
    running = np.searchsorted(-size[order], -np.arange(int(size[order[0]]) if len(order) else 0), "left")
    for k, m in enumerate(running.tolist()):
        r[:m] = shifted(r[:m], x[at[:m] + k])
    out[order] = r
    return out


def runs(x: np.ndarray, bounds: np.ndarray, before: np.uint32 | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint32 | None]:
    """Of texts x[bounds[i] : bounds[i + 1]] (bytes by CLASS): text and CRC register of each word, text and register of each run of two, and
    the register after the last word and a blank. before: that of the piece before, if x goes on in a text."""
    inside, edge = x != 0, np.zeros(len(x) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1])) if len(x) else np.empty(0, np.int64)
    stop = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1 if len(x) else start
    text = np.searchsorted(bounds, start, "right") - 1
    one = advanced(np.full(len(start), START), x, start, stop - start)
    then = shifted(one, np.uint8(32))
    pair = np.flatnonzero(text[1:] == text[:-1]) + 1
    begin = then[pair - 1]
    if before is not None and len(start):
        pair, begin = np.append(0, pair), np.append(before, begin)
    two = advanced(begin, x, start[pair], (stop - start)[pair])
    return text, one, text[pair], two, then[-1] if len(start) else before


def pieces(x: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about STEP bytes that end between words."""
    a = 0
    while a < len(x):
        b = a + STEP
        while b < len(x) and x[b] and x[b - 1]:
            gap = np.flatnonzero(x[b : b + STEP] == 0)
            b = b + int(gap[0]) if len(gap) else b + STEP
        yield x[a : min(b, len(x))]
        a = b


def bucketed(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a column: from row a to b, the rows (from a) and buckets of features, and words by row. The rows of a text above STEP
    bytes come several times."""
    col = texts.cast(pa.large_string()).fill_null("")
    _, bounds, data = col.buffers()
    at = np.frombuffer(bounds, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    of = lambda reg: (reg ^ START).astype(np.int64) % buckets
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(at, at[a] + STEP, "right")) - 1)
        x = CLASS[raw[at[a] : at[b]]]
        before = None
        for p in [x] if b > a + 1 or len(x) <= STEP else pieces(x):
            text, one, text_two, two, before = runs(p, at[a : b + 1] - at[a] if p is x else np.array([0, len(p)]), before)
            yield a, b, np.append(text, text_two), np.append(of(one), of(two)), np.bincount(text, minlength=b - a)
        a = b


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket. Tasks add up their own; `buckets` sums come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, of, _ in bucketed(b.column(0), buckets):
                total += np.bincount(of, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_arrow(df.select(F.col(text_col).alias("text")), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: the log of its share of the target over its share of the source, each with one more in every bucket, in
    thousandths, floored."""
    n = len(source)
    return np.floor(1000 * np.log((target + 1) * float(source.sum() + n) / ((source + 1) * float(target.sum() + n)))).astype(np.int64)


def weighed(df: DataFrame, text_col: str, gain: np.ndarray) -> DataFrame:
    """df without text_col, with n_words, n_features and weight: the floored mean gain of the features of each row."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches):
        for b in batches:
            texts, more = b.column(b.schema.get_field_index(text_col)), [b.column(b.schema.get_field_index(c)) for c in keep]
            sums = np.zeros((3, b.num_rows), np.int64)
            for lo, hi, row, of, words in bucketed(texts, len(gain)):
                sums[0, lo:hi] += words
                sums[1, lo:hi] += np.bincount(row, minlength=hi - lo)
                sums[2, lo:hi] += np.bincount(row, gain[of], hi - lo).astype(np.int64)  # exact: far below 2**53
            mean = sums[2] // np.maximum(sums[1], 1)
            yield pa.RecordBatch.from_arrays([*more, pa.array(sums[0]), pa.array(sums[1]), pa.array(mean)], [*keep, "n_words", "n_features", "weight"])

    kinds = T.StructType(df.select(*map(quoted, keep)).schema.fields + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return map_arrow(df, run, kinds)


def noise(id_col: F.Column, seed: int) -> F.Column:
    """Gumbel noise of an id in thousandths, floored: from the first 32 bits of a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def placed(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank to rows (id, n_words, score and others) of a written table: 1, 2, 3 ... for the percent of rows with at least
    least_words words that score highest, else null."""
    spark = rows.sparkSession
    fit = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    salt = F.xxhash64(F.monotonically_increasing_id())  # parts rows of one id that repeats without end
    order = [F.col("score").desc(), F.col("id"), F.col("salt")]
    dealt = rows.filter(fit).withColumn("salt", salt).repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    names = dealt.columns

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n + 1, n + b.num_rows + 1))], [*names, "part", "place"])
            n += b.num_rows

    kinds = T.StructType(dealt.schema.fields + [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    numbered, _ = written(spark, map_arrow(dealt, number, kinds), "importance-places")
    sizes = numbered.groupBy("part").agg(F.max("place").alias("size"))  # a row for each range partition
    sizes = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    drawn = numbered.count() * percent // 100
    rank = F.col("before") + F.col("place")
    out = numbered.join(F.broadcast(sizes), "part").withColumn("rank", F.when(rank <= drawn, rank)).select(*names, "rank")
    return out.unionByName(rows.filter(~F.coalesce(fit, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank of every row of df: how much its features are the target's, the same with
    noise, and its place among the rows drawn (null: not drawn)."""
    gain = gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = weighed(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", gain)
    rows, _ = written(df.sparkSession, rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "importance-rows")
    return placed(rows, percent, least_words).withColumnRenamed("id", id_col)


def drawn_rows(df: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The rows of df that are drawn, with all their columns. They are told by the score and id of the last one drawn, so no
    text is shuffled; of rows that repeat at just that place all stay."""
    spark = df.sparkSession
    gain = gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_col, buckets))
    packed = df.select(F.struct(*map(quoted, df.columns)).alias("row"), F.col(text_col).alias("text"))
    score = F.col("weight") + noise(F.col("row." + quoted(id_col)), seed)
    rows, path = written(spark, weighed(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "importance-rows")
    last = placed(rows, percent, least_words).filter("rank IS NOT NULL").agg(F.max(F.struct("rank", "score", "id")).alias("r")).select("r.*").first()
    remove(spark, path)
    if last["rank"] is None:
        return df.limit(0)
    scored = weighed(packed, "text", gain).withColumn("score", score)
    i = F.col("row." + quoted(id_col))
    return scored.filter((F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | (F.col("score") == last["score"]) & (i <= F.lit(last["id"])))).select("row.*")
