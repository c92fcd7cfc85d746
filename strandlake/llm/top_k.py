"""Exact top-k search by inner products (operator 3).

Queries are dealt into tiles and candidates into shards, both of bounded bytes, by hashes. Every tile meets every shard in a group of
its own (a stated query set against all rows, in blocks): tiles are sent once for each shard and shards once for each tile, on
executors, and nothing of either passes through the driver. In a group, candidates come by in pieces; queries times a piece is
one matrix product, after which each query keeps what reaches the k-th best score seen so far (ties included until ids decide).
A group thus ends with k rows a query, and those lists are merged by a tree: first within sets of shards, then over all.

How many tiles and shards: the bytes of either side over `tile_bytes`. Work is the product of the two sides, of which a group does
tile_bytes squared; what is moved is smaller than that by the rows of a tile.

Components are floor(scale * x) of x as double. Products are done in double precision where every sum stays below 2**53,
which makes them exact, and in Python integers otherwise; scores beyond a long are held at its limits.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id;
only vectors of equal length are compared; a query meets every row but those with its own id; equal query rows count once;
repeated candidate rows each count; ties go to the smaller id; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import ship

QUERY_TILE, TILE = 512, 2048


def sound(col: str) -> F.Column:
    """Whether a vector has only finite components."""
    x = F.col(col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad, F.lit(False))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all pairs, int64."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(q).astype(object) @ whole(c).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each of n queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.id = np.full((len(ids), k), -1, np.int64)
        self.filled = np.zeros((len(ids), k), bool)

    def add(self, cand_ids: np.ndarray, cand: np.ndarray) -> None:
        for a in range(0, len(self.ids), QUERY_TILE):
            b = min(a + QUERY_TILE, len(self.ids))
            s = products(self.vectors[a:b], cand)
            ok = self.ids[a:b, None] != cand_ids[None, :]
            low = np.iinfo(np.int64).min
            line = np.where(self.filled[a:b, -1], self.score[a:b, -1], low)  # what the k-th has
            if len(cand_ids) > self.k:
                line = np.maximum(line, np.partition(np.where(ok, s, low), -self.k, axis=1)[:, -self.k])
            row, col = np.nonzero((s >= line[:, None]) & ok)
            if not len(row):
                continue
            old_row, old_at = np.nonzero(self.filled[a:b])
            rows = np.concatenate([old_row, row])
            scores = np.concatenate([self.score[a:b][old_row, old_at], s[row, col]])
            ids = np.concatenate([self.id[a:b][old_row, old_at], cand_ids[col]])
            order = np.lexsort((ids, -scores.astype(object) if (scores == low).any() else -scores, rows))
            rows, scores, ids = rows[order], scores[order], ids[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
            top = rank < self.k
            self.score[a + rows[top], rank[top]], self.id[a + rows[top], rank[top]] = scores[top], ids[top]
            self.filled[a + rows[top], rank[top]] = True


def by_length(table: pa.Table, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors of a table of the two, by length of vector."""
    out = {}
    ids, col = table.column(0).to_numpy(), table.column(1).combine_chunks()
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    flat, start = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == d)
        out[d] = ids[mine].astype(np.int64), np.floor(flat[start[mine][:, None] + np.arange(d)] * scale) if d else np.zeros((len(mine), 0))
    return out


def lists_of(queries: pa.Table, candidates: pa.Table, k: int, scale: float, shard: int) -> pa.Table:
    """The k best of a shard for every query of a tile."""
    found, ids, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if queries.num_rows and candidates.num_rows:
        others = by_length(candidates.select(["c_id", "c_v"]), scale)
        for d, (q, v) in by_length(queries.select(["id", "v"]), scale).items():
            if d not in others:
                continue
            best = Best(q, v, k)
            c, w = others[d]
            for at in range(0, len(c), TILE):
                best.add(c[at : at + TILE], w[at : at + TILE])
            row, at = np.nonzero(best.filled)
            found.append(best.ids[row])
            ids.append(best.id[row, at])
            scores.append(best.score[row, at])
    return pa.table({"query_id": np.concatenate(found), "vec_id": np.concatenate(ids), "score": np.concatenate(scores), "shard": np.full(sum(map(len, ids)), shard, np.int32)})


def top_k(df: DataFrame, is_query: F.Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", tile_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row with all other rows."""
    ship(df.sparkSession)
    rows = df.filter(sound(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    queries = rows.filter(is_query(F.col("id"))).distinct()
    size = lambda x: x.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0]
    tiles, shards = (max(1, -(-3 * size(x) // (2 * tile_bytes))) for x in (queries, rows))  # room for uneven hashing
    shards = max(shards, df.sparkSession.sparkContext.defaultParallelism // tiles)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("shard", each(shards))
    # the partition goes into the hash, for an id that very many rows share
    c = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(shards)).cast("int")).withColumn("tile", each(tiles))
    # names of the two sides must differ: both come from one table
    c = c.select(F.col("tile").alias("c_tile"), F.col("shard").alias("c_shard"), F.col("id").alias("c_id"), F.col("v").alias("c_v"))
    met = q.select("tile", "shard", "id", "v").groupBy("tile", "shard").cogroup(c.groupBy("c_tile", "c_shard"))
    out = met.applyInArrow(lambda key, a, b: lists_of(a, b, k, scale, key[1].as_py()), "query_id bigint, vec_id bigint, score bigint, shard int")
    order = [F.col("score").desc(), F.col("vec_id")]
    first = out.withColumn("g", F.floor(F.col("shard") / F.lit(max(1, int(shards**0.5))))).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "g").orderBy(*order))).filter(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("query_id", "rank", "vec_id", "score")
