"""Queries of the training-data operators, by the names that the entry module registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import byte_bpe, compression_quality, importance, jaccard_join, lexical_search, licenses, mixing, simhash, substring_dedup, tiff, token_counts, top_k, warc

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"


def register(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), BPE_RANKS)


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), PIECE_MODEL, limit=4096)


@register("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@register("op2_compression_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = compression_quality.score_texts(docs, model, threshold=0.3)
    return out.select("doc_id", compression_quality.held_out("doc_id").alias("held_out"), "score", "predicted")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op3_top_k_search", TOP_K_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, k=5, scale=256.0)


@register("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_tiff_media")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_features(documents(spark, sf_dir))


@register("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_words(documents(spark, sf_dir), window=50)


@register("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir), n=3, percent=90)


@register("op7_license_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(documents(spark, sf_dir))
    names = F.array_distinct(F.transform("matches", lambda m: m["license"]))
    return out.select("doc_id", "n_sentences", "n_known", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# the CRC of each different feature by a fold over its bytes, with the table made by eight shifts
IMPORTANCE_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT side, r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), features AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split
), known AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc
), counted AS (
  SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM features JOIN known USING (f) GROUP BY bucket
), total AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counted),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS gain FROM counted, total
), weights AS (
  SELECT r, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM features JOIN known USING (f) JOIN gain USING (bucket) WHERE side = 's' GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (r) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND score IS NOT NULL AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""


@register("op11_importance_resampling", IMPORTANCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, least_words=20, buckets=10_000, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), distance=2, n=3, seed=42)


SEARCH_SQL = f"""
WITH found AS (
  SELECT doc_id, r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), sizes AS (SELECT r, doc_id, count(*) AS n FROM found GROUP BY r, doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
tf AS (SELECT r, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM tf JOIN w USING (term) JOIN sizes USING (r), total
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts JOIN asked USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@register("op13_lexical_search", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)
