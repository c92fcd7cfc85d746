"""Substring dedup by level-wise doubling (operator 8).

A window is `window` consecutive words of one document; words covered by a window that also starts in a document with a
smaller id go. Equal documents are settled first, as classes of equal word sequences: all but the members with the class's
smallest id lose everything (if they have a window at all), and only one member of a class goes on.

Levels are the window's length halved again and again down to `least` words or more (50: 12, 25, 50). On the first, each full
window is stood for by the one short window inside it that has the least hash; this depends on the words alone, so equal
windows choose alike, and about one position in twenty is chosen at all. What is chosen in one class alone is dropped, and what is
repeated goes on: of the windows that chose a survivor, windows of twice the length are chosen, counted and dropped in the same
way, until none survive or the length is that of the window. There the windows themselves, that is their hashes (128 bits with that of
the half window), get the smallest id of a class that has them. Each level reads only documents with survivors of the one before.
All levels count by map-side combined aggregation, written before it is joined back, so a passage that a third of all
documents share collapses before it is shuffled, and what joins back can be split.

Defined results: a null text has no words; a text of fewer words than a window keeps them all; very long texts are read whole, and
have as many windows as they have; a null id counts as larger than every id; rows that share an id judge nothing among
themselves; repeated rows give repeated results; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import WordHashes, free, hashed, map_arrow, quoted, remove, signed, sliding_min, two_longs, window_hashes, words, written

MARK_BASE, FULL_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
NOTHING = hashlib.sha256(b"").hexdigest()
LAST = (1 << 63) - 1  # stands for a null id


def levels_of(window: int, least: int = 10) -> list[int]:
    """Lengths below the window's, ascending: its half, the half of that, and so on."""
    out = [max(1, window // 2)]
    while out[-1] // 2 >= least:
        out.append(out[-1] // 2)
    return out[::-1]


def chosen(h: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each full window the least hash of the windows of `length` inside it. h: hashes of the words."""
    return sliding_min(window_hashes(h, length, MARK_BASE), window - length + 1)


def digest_pass(texts: DataFrame, length: int, window: int) -> DataFrame:
    """Of each row (id, text, h1, h2): its class (128-bit hash of the word sequence), words, digest of all words, and the windows
    of the first level that its full windows choose."""

    def run(batches):
        hashes = WordHashes(3)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    ws = words(text)
                    joined = b" ".join(ws)
                    marks = np.unique(chosen(hashes.of(ws), length, window)) if len(ws) >= window else np.empty(0, np.uint64)
                    rows.append((*two_longs(xxhash.xxh3_128_intdigest(joined)), len(ws), hashlib.sha256(joined).hexdigest(), signed(marks)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                arrays = [part.column(0), part.column(2), part.column(3), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "h1", "h2", "c1", "c2", "n_words", "full_sha", "marks"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts, run, f"id {kind}, h1 bigint, h2 bigint, c1 bigint, c2 bigint, n_words bigint, full_sha string, marks array<bigint>")


def level_pass(df: DataFrame, length: int, twice: int, window: int) -> DataFrame:
    """Of each row (rep, c1, c2, alive, text): the windows of the next level that are chosen by full windows which chose a survivor
    on this one."""

    def run(batches):
        hashes = WordHashes(3)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out = []
                for rep, c1, c2, alive, text in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)):
                    h = hashes.of(words(text))
                    open_ = np.isin(chosen(h, length, window), np.array(alive, np.int64).view(np.uint64))
                    out.append((rep, c1, c2, text, signed(np.unique(chosen(h, twice, window)[open_]))))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["rep", "c1", "c2", "text", "marks"])

    return map_arrow(df.select("rep", "c1", "c2", "alive", "text"), run, "rep bigint, c1 bigint, c2 bigint, text string, marks array<bigint>")


def window_pass(df: DataFrame, length: int, window: int) -> DataFrame:
    """Of each row (rep, c1, c2, alive, text): its full windows that chose a survivor of the last level, by position."""

    def run(batches):
        hashes = WordHashes(3)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out = []
                for rep, c1, c2, alive, text in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)):
                    h = hashes.of(words(text))
                    least = chosen(h, length, window)
                    at = np.flatnonzero(np.isin(least, np.array(alive, np.int64).view(np.uint64)))
                    out.append((rep, c1, c2, text, at.astype(np.int32), signed(least[at]), signed(window_hashes(h, window, FULL_BASE)[at])))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["rep", "c1", "c2", "text", "at", "w1", "w2"])

    return map_arrow(df.select("rep", "c1", "c2", "alive", "text"), run, "rep bigint, c1 bigint, c2 bigint, text string, at array<int>, w1 array<bigint>, w2 array<bigint>")


def keep_pass(df: DataFrame, window: int) -> DataFrame:
    """Of each row (c1, c2, text, at): how many words the windows at these positions cover, and the others."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out = []
                for c1, c2, text, at in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)):
                    ws = words(text)
                    edge = np.zeros(len(ws) + 1, np.int32)
                    at = np.unique(np.array(at))
                    edge[at] += 1
                    edge[at + window] -= 1
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    out.append((c1, c2, len(ws) - len(kept), b" ".join([ws[i] for i in kept.tolist()]).decode("utf-8")))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["c1", "c2", "n_removed", "kept"])

    return map_arrow(df.select("c1", "c2", "text", "at"), run, "c1 bigint, c2 bigint, n_removed bigint, kept string")


def survivors(marked: DataFrame) -> tuple[DataFrame, list[str]]:
    """rep, c1, c2 and the marks (alive) that a class with another smallest id has too, and the tables behind that. marked: rep, c1,
    c2, marks."""
    spark = marked.sparkSession
    marks = marked.select("rep", "c1", "c2", F.explode("marks").alias("mark"))
    alive, path = written(spark, marks.groupBy("mark").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("mark"), "dedup-marks")
    docs, docs_path = written(spark, marks.join(alive, "mark").groupBy("rep", "c1", "c2").agg(F.collect_list("mark").alias("alive")), "dedup-alive")
    return docs, [path, docs_path]


def repeats(texts: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(rows, found) of texts (id, text, h1, h2). rows: id, h1, h2, c1, c2, n_words, full_sha of every row; found: c1, c2, rep of
    every class, with n_removed and kept (text) where the smallest member loses words."""
    spark, levels = texts.sparkSession, levels_of(window)
    rows, rows_path = written(spark, digest_pass(texts, levels[0], window), "dedup-rows")
    number = F.coalesce(F.col("id").cast("long"), F.lit(LAST))
    classes = rows.groupBy("c1", "c2").agg(F.min(F.struct(number.alias("rep"), "h1", "h2")).alias("r"), F.first("marks").alias("marks")).select("c1", "c2", "r.*", "marks")
    classes, classes_path = written(spark, classes, "dedup-classes")
    rows, _ = written(spark, rows.drop("marks"), "dedup-ids")
    remove(spark, rows_path)
    free(spark)
    marked, cut_path = classes, []
    for k, length in enumerate(levels):
        alive, paths = survivors(marked)
        if k == 0:
            # equal texts are one before they are moved
            one = texts.filter(F.length("text") >= 2 * window - 1).groupBy("h1", "h2").agg(F.first("text").alias("text"))
            of = classes.select("c1", "c2", "h1", "h2").join(alive, ["c1", "c2"]).join(one, ["h1", "h2"])
        else:
            of = marked.select("c1", "c2", "text").join(alive, ["c1", "c2"])
        last = k == len(levels) - 1
        marked, path = written(spark, window_pass(of, length, window) if last else level_pass(of, length, levels[k + 1], window), "dedup-level")
        remove(spark, *paths, *cut_path)
        cut_path = [path]
        free(spark)
        if marked.isEmpty():
            break
    reps = classes.select("c1", "c2", "rep")
    if marked.isEmpty():
        found = reps.select("*", F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept"))
    else:
        each = marked.select("rep", "c1", "c2", F.explode(F.arrays_zip("at", "w1", "w2")).alias("w")).select("rep", "c1", "c2", "w.*")
        first, first_path = written(spark, each.groupBy("w1", "w2").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("w1", "w2", "lo"), "dedup-first")
        hits, hits_path = written(spark, each.join(first, ["w1", "w2"]).filter("lo < rep").groupBy("c1", "c2").agg(F.collect_list("at").alias("at")), "dedup-hits")
        partial, partial_path = written(spark, keep_pass(marked.select("c1", "c2", "text").join(hits, ["c1", "c2"]), window), "dedup-partial")
        found = reps.join(partial, ["c1", "c2"], "left")
        cut_path += [first_path, hits_path, partial_path]
    found, _ = written(spark, found, "dedup-found")
    remove(spark, classes_path, *cut_path)
    free(spark)
    return rows, found


def removed_words(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed and kept_sha256 (of the kept words joined by blanks) per row of df."""
    rows, found = repeats(hashed(df, id_col, text_col), window)
    found = found.select("c1", "c2", "rep", "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    copy = F.coalesce(F.col("id").cast("long"), F.lit(LAST)) > F.col("rep")
    whole = copy & (F.col("n_words") >= window)
    out = rows.join(found, ["c1", "c2"])
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.when(whole, F.col("n_words")).when(copy, F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(NOTHING)).when(copy, F.col("full_sha")).otherwise(F.coalesce("kept_sha", "full_sha")).alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, without the words that repeat; rows that lose all they had go. A text that
    loses words has the others joined by blanks; other texts stay as they are."""
    spark = df.sparkSession
    rows, found = repeats(hashed(df, id_col, text_col), window)
    number = F.coalesce(F.col("id").cast("long"), F.lit(LAST))
    told = rows.select("id", "h1", "h2", "c1", "c2", "n_words").distinct().join(found, ["c1", "c2"])
    gone = (number > F.col("rep")) & (F.col("n_words") >= window) | (F.coalesce("n_removed", F.lit(0)) == F.col("n_words")) & (F.col("n_words") > 0) & (number == F.col("rep"))
    told = told.withColumn("gone", gone).withColumn("left", F.when(number == F.col("rep"), F.col("kept"))).filter("gone OR left IS NOT NULL")
    told, _ = written(spark, told.select(F.col("id").alias("told_id"), F.col("h1").alias("told_1"), F.col("h2").alias("told_2"), "gone", "left"), "dedup-told")
    # rows travel as one column, so their names cannot clash; the hash of the text tells rows apart that share an id
    packed = hashed(df.select(F.struct(*df.columns).alias("row")), "row." + quoted(id_col), "row." + quoted(text_col), "row").drop("text").withColumnRenamed("id", "row_id")
    same = F.col("told_id").eqNullSafe(F.col("row_id")) & (F.col("h1") == F.col("told_1")) & (F.col("h2") == F.col("told_2"))
    out = packed.join(told, same, "left").filter(~F.coalesce("gone", F.lit(False)))
    return out.select(F.col("row").withField(quoted(text_col), F.coalesce("left", F.col("row." + quoted(text_col)))).alias("row")).select("row.*")
