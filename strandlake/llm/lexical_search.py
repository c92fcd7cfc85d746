"""Ranked lexical search with block-max pruning (operator 13).

Documents, as they lie in a partition, are cut into blocks of BLOCK_DOCS documents (fewer where these have many postings). A block
is a row of a table: its documents with their postings in forward order (document by document: term, impact), and the greatest impact of each
term in it. Impact is what a term gives to the score but for the term's weight; weights and impacts are whole numbers not below zero, so the
weighted sum of a query's greatest impacts bounds the score of every document of the block.

A search goes over the blocks twice. First only over maxima: of each query the blocks with the highest bounds (one of each of SEEDS shares of the
blocks) are scored, and the k-th best score in them is a line that no document of the result lies below. Then over all blocks: those at hand
are sorted by the query's bound and scored from the top, until the bound drops below the line or the task's own k-th best. Tasks keep k rows a query;
the lists are merged in two steps.

The query set is bounded by what goes with a task: items are hashed into groups of about PAIRS (item, term) pairs, each of
which is a search of its own; its terms are the vocabulary to which the index is cut. Vocabulary, weights and lines of a group pass through the driver.

Defined results: a null text, and one without terms, counts nowhere and is never found; whole texts are read; a row without doc_id counts in
the statistics and is not given out; repeated rows count and are ranked each on its own; rows of one item are one query with the terms of
all of them; items without terms and empty tables give nothing; equal scores go by ascending id; other columns play no part.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import free, map_arrow, remove, ship, written

BLOCK_DOCS, BLOCK_POSTINGS, SEEDS, PAIRS = 256, 1 << 15, 4, 200_000
NOBODY = -(1 << 63)  # stands for a null id
#: By byte: A-Z lower-cased, a blank for what is no part of a term (all ASCII but digits and letters).
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BLOCKS = "block bigint, n_docs bigint, n_terms bigint, ids array<bigint>, sizes array<bigint>, counts array<int>, terms array<int>, tf array<bigint>"
SCORED = "block bigint, ids array<bigint>, counts array<int>, terms array<int>, impact array<int>, at array<int>, most array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(TERM_BYTES).split() if text else []


class Scoring(NamedTuple):
    """Whole-number BM25: impact = (1e9 * tf) div (1000 * tf + k * m), m = 100 - b + (b * n * N) div L."""

    b: int = 90
    k: int = 8

    def impact(self, tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        """size: terms of the posting's document."""
        if len(size) and self.b * int(size.max()) * n_docs >= 1 << 63:  # beyond 64 bits
            m = np.array([100 - self.b + self.b * s * n_docs // n_terms for s in size.tolist()], np.int64)
        else:
            m = 100 - self.b + self.b * size * n_docs // max(1, n_terms)
        return 1_000_000_000 * tf // (1000 * tf + self.k * m)


def forward_pass(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of docs (id, text) with the terms of a vocabulary; documents without any of these are in n_docs and n_terms only."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get, part, number = known.value.get, TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        n_docs = n_terms = postings = 0

        def block():
            cat = lambda k, kind: np.concatenate([h[k] for h in held]).astype(kind) if held else np.empty(0, kind)
            row = [[part << 32 | number], [n_docs], [n_terms], [[h[0] for h in held]], [[h[1] for h in held]], [[len(h[2]) for h in held]], [cat(2, np.int32)], [cat(3, np.int64)]]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for k in range(0, b.num_rows, 512):
                for i, text in zip(*(c.to_pylist() for c in b.slice(k, 512).columns)):
                    found = terms_of(text)
                    n_docs, n_terms = n_docs + bool(found), n_terms + len(found)
                    at = np.fromiter((get(t, -1) for t in found), np.int32, len(found))
                    term, tf = np.unique(at[at >= 0], return_counts=True)
                    if len(term):
                        held.append((NOBODY if i is None else i, len(found), term, tf))
                        postings += len(term)
                    if len(held) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                        yield block()
                        held, number, n_docs, n_terms, postings = [], number + 1, 0, 0, 0
        if n_docs:
            yield block()

    return map_arrow(docs, run, BLOCKS)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each list begins and ends."""
    at = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    return column.flatten().to_numpy(zero_copy_only=False), at


def maxima_pass(blocks: DataFrame, scoring: Scoring, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks with impacts in place of frequencies, and the greatest impact of each term."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                block, _, _, ids, sizes, counts, terms, tf = (c[0].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[0] for c in b.slice(k, 1).columns)
                impact = scoring.impact(tf, np.repeat(sizes, counts), n_docs, n_terms)
                order = np.argsort(terms, kind="stable")
                at, first = np.unique(terms[order], return_index=True)
                most = np.maximum.reduceat(impact[order], first)
                row = [[block.as_py()], [ids], [counts], [terms], [impact.astype(np.int32)], [at.astype(np.int32)], [most.astype(np.int32)]]
                kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], [c.split()[0] for c in SCORED.split(", ")])

    return map_arrow(blocks, run, SCORED)


class Queries:
    """A group's queries as flat arrays, in order of item: terms and weights, where each query begins, and its line."""

    def __init__(self, term: np.ndarray, weight: np.ndarray, begin: np.ndarray, size: int):
        self.term, self.weight, self.begin, self.size = term, weight, begin, size
        self.line = np.ones(len(begin) - 1, np.int64)

    def bounds(self, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of a block, by query: no document in it scores higher. Every query has a term."""
        here = np.zeros(self.size, np.int64)
        here[at] = most
        return np.add.reduceat(here[self.term] * self.weight, self.begin[:-1])

    def scores(self, q: int, terms: np.ndarray, impact: np.ndarray, start: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        """Of a block's documents. start: where each one's postings begin. scratch: zeros by term, left as they were."""
        mine = slice(self.begin[q], self.begin[q + 1])
        scratch[self.term[mine]] = self.weight[mine]
        out = np.add.reduceat(scratch[terms] * impact, start)
        scratch[self.term[mine]] = 0
        return out


class Lists:
    """The k best documents of each query so far."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, self.best = queries, k, {}
        self.line = queries.line.copy()

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = np.flatnonzero((scores >= self.line[q]) & (ids != NOBODY))
        if not len(hit):
            return
        old = self.best.get(q)
        s, i = (scores[hit], ids[hit]) if old is None else (np.append(old[0], scores[hit]), np.append(old[1], ids[hit]))
        order = np.lexsort((i, -s))[: self.k]
        self.best[q] = s[order], i[order]
        if len(order) == self.k:
            self.line[q] = max(self.line[q], s[order[-1]])

    def rows(self, part: int) -> pa.RecordBatch:
        qs = list(self.best)
        n = [len(self.best[q][0]) for q in qs]
        cat = lambda k: np.concatenate([self.best[q][k] for q in qs]) if qs else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qs, np.int64), n)), pa.array(cat(1)), pa.array(cat(0)), pa.array(np.full(sum(n), part, np.int32))], ["q", "id", "score", "part"])


FOUND = "q bigint, id bigint, score bigint, part int"


def seeds(blocks: DataFrame, queries: Queries) -> DataFrame:
    """block, qs: the queries whose highest bound in a share of the blocks is this block's."""

    def run(batches):
        bound, where = np.zeros((2, SEEDS, len(queries.line)), np.int64)
        for b in batches:
            (at, begin), (most, _) = flat(b.column(1)), flat(b.column(2))
            for block, lo, hi in zip(b.column(0).to_pylist(), begin[:-1], begin[1:]):
                own, share = queries.bounds(at[lo:hi], most[lo:hi]), block % SEEDS
                better = own > bound[share]
                bound[share, better], where[share, better] = own[better], block
        share, q = np.nonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (q, share, bound[share, q], where[share, q])], ["q", "share", "bound", "block"])

    each = map_arrow(blocks.select("block", "at", "most"), run, "q bigint, share bigint, bound bigint, block bigint")
    top = each.groupBy("q", "share").agg(F.max(F.struct("bound", "block")).alias("b"))
    return top.groupBy(F.col("b.block").alias("seed")).agg(F.collect_list("q").alias("qs"))


def score_pass(blocks: DataFrame, queries: Queries, k: int) -> DataFrame:
    """q, id, score, part: the k best of each task's blocks, by the queries `qs` of a block if there is such a column, else all whose bound
    reaches the line."""
    chosen = "qs" in blocks.columns
    cols = ["ids", "counts", "terms", "impact", "at", "most"]

    def run(batches):
        lists, scratch = Lists(queries, k), np.zeros(queries.size, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, min(64, b.num_rows - lo))
                (ids, ids_at), (counts, _), (terms, terms_at), (impact, _), (at, at_at), (most, _) = (flat(part.column(c)) for c in cols)
                start = [np.cumsum(counts[a:e]) - counts[a:e] for a, e in zip(ids_at[:-1], ids_at[1:])]
                bound = np.stack([queries.bounds(at[a:e], most[a:e]) for a, e in zip(at_at[:-1], at_at[1:])])
                if chosen:
                    asked = np.zeros(bound.shape, bool)
                    for i, qs in enumerate(part.column("qs").to_pylist()):
                        asked[i, qs] = True
                    bound = np.where(asked, bound, 0)
                order = np.argsort(-bound, axis=0, kind="stable")
                for q in np.flatnonzero(bound.max(0) >= lists.line).tolist():
                    for i in order[:, q].tolist():
                        if bound[i, q] < lists.line[q]:
                            break
                        own = slice(terms_at[i], terms_at[i + 1])
                        lists.add(q, ids[ids_at[i] : ids_at[i + 1]], queries.scores(q, terms[own], impact[own], start[i], scratch))
        yield lists.rows(TaskContext.get().partitionId())

    return map_arrow(blocks.select(*cols, *(["qs"] if chosen else [])), run, FOUND)


def best_of(found: DataFrame, k: int, groups: int) -> DataFrame:
    """The k best of each query, by groups of tasks and then altogether."""
    order = [F.col("score").desc(), F.col("id")]
    first = found.withColumn("g", F.col("part") % groups).withColumn("rank", F.row_number().over(Window.partitionBy("q", "g").orderBy(*order))).filter(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k).select("q", "rank", "id", "score")


def search_group(docs: DataFrame, pairs: list[tuple[int, bytes]], k: int, scoring: Scoring) -> DataFrame:
    """q, rank, id, score for queries 0, 1, 2 ..., given as different (q, term)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
    forward, forward_path = written(spark, forward_pass(docs, vocabulary), "search-forward")
    n_docs, n_terms = forward.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the group
        df[term] = n
    blocks, _ = written(spark, maxima_pass(forward.filter(F.size("ids") > 0), scoring, n_docs, n_terms), "search-blocks")
    remove(spark, forward_path)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    rows = sorted((q, vocabulary[t]) for q, t in pairs)
    number, term = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    begin = np.flatnonzero(np.append(True, np.diff(number)))
    queries = Queries(term, weight[term], np.append(begin, len(rows)), len(vocabulary))
    top, _ = written(spark, seeds(blocks, queries), "search-seeds")  # at most SEEDS rows a query of the group
    seeded = score_pass(blocks.join(F.broadcast(top), F.col("block") == F.col("seed")), queries, k)
    for q, line in best_of(seeded, k, 16).filter(F.col("rank") == k).select("q", "score").collect():
        queries.line[q] = max(1, line)
    free(spark)
    return best_of(score_pass(blocks, queries, k), k, 16)


def search(df: DataFrame, items: DataFrame, k: int = 10, scoring: Scoring = Scoring(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """item_col, rank, id_col, score: the k rows of df that score highest for each item, with a score above 0."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    plain = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).alias("term")
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).select("item", term).distinct()
    asked, _ = written(spark, asked, "search-asked")
    groups = -(-asked.count() // pairs)
    out = []
    for g in range(groups):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        if not mine:
            continue
        number = {x: i for i, x in enumerate(sorted({r["item"] for r in mine}, key=lambda x: (x is None, x)))}
        found = search_group(docs, [(number[r["item"]], r["term"].encode("utf-8")) for r in mine], k, scoring)
        names = spark.createDataFrame([(i, x) for x, i in number.items()], f"number int, item {asked.schema['item'].dataType.simpleString()}")
        out.append(found.join(F.broadcast(names), F.col("q") == F.col("number")).select("item", "rank", "id", "score"))
    if not out:
        out = [asked.join(docs.limit(0).select("id"), F.lit(False)).select("item", F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
