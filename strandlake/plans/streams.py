"""Streaming queries over the events table, equal to their batch twins."""

from pyspark.sql import functions as F

from strandlake.plans import register
from strandlake.session import table
from strandlake.streaming import ordered
from strandlake.streaming import windows as w


def plain(df):
    """Times without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("beg", "end") if c in df.columns})


@register("stream_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS beg, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return w.run_to_end(w.tumbling(w.stream_of(spark, sf, "events"), "ts", "1 day", "event_type")).withColumn("total", F.round("total", 2)).transform(plain)


@register("stream_sliding", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - (k * INTERVAL '6 hours') AS beg, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES (0), (1), (2), (3)) v(k) GROUP BY ALL")
def stream_sliding(spark, sf):
    return w.run_to_end(w.sliding(w.stream_of(spark, sf, "events"), "ts", "1 day", "6 hours")).transform(plain)


@register("stream_session", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS beg, max(ts) + INTERVAL '12 hours' AS \"end\", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, sf):
    return w.run_to_end(w.sessions(w.stream_of(spark, sf, "events"), "ts", "12 hours", "user_id")).transform(plain)


@register("stream_watermark_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_watermark_dedup(spark, sf):
    return w.run_to_end(w.dedup(w.stream_of(spark, sf, "events").select("user_id", "event_type", "ts"), "ts", "user_id", "event_type", delay="3650 days").select("user_id", "event_type"), "append")


@register("stream_in_order", "WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\", event_id FROM events) SELECT user_id, \"at\", event_id, row_number() OVER (PARTITION BY user_id ORDER BY \"at\", event_id) AS place FROM e")
def stream_in_order(spark, sf):
    """Events that arrive up to eight hours late, in six triggers of as long a time each; each user's leave in order."""
    e = table(spark, sf, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    lo, hi = e.agg(F.min("at"), F.max("at")).first()
    late = F.col("at") + F.pmod(F.xxhash64("event_id"), F.lit(8 * 3600))
    part = F.floor((late - lo) * 6 / (hi - lo + 8 * 3600))
    stream = ordered.arriving(e, part, 6)
    return ordered.run_in_order(stream, ["user_id"], "at", 9 * 3600, ("event_id",))
