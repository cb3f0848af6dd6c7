"""Streaming queries: each runs its stream to the end of the available files and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.catalog import SETTLED
from corpusloom.plans.corpus import CHAPTERS, DEMO_RULES
from corpusloom.plans.registry import query, sql_text, table
from corpusloom.session import work_dir
from corpusloom.streaming import jobs as J

STRIP = sql_text(T.STRIP_CHARS)


def places(spark, name):
    base = work_dir(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@query("t1_stream_chapters", f"""
WITH {CHAPTERS} SELECT doc_id, seq, coalesce(heading, '') AS heading, length(body) AS body_chars FROM chapters WHERE seq > 0 OR body <> ''""")
def stream_chapters(spark, sf_dir):
    path, checkpoint = places(spark, "chapters")
    # One small file makes one task per batch; deal the texts out before the row-wise split.
    docs = J.table_stream(spark, sf_dir, "documents").select("doc_id", "text").repartition(
        spark.sparkContext.defaultParallelism)
    J.stream_chapters(docs, path, checkpoint, DEMO_RULES, "doc_id").awaitTermination()
    return spark.read.parquet(path).select(
        "doc_id", "seq", F.coalesce("heading", F.lit("")).alias("heading"), F.length("body").alias("body_chars"))


@query("t2_stream_job_status", f"WITH {SETTLED}")
def stream_job_status(spark, sf_dir):
    path, checkpoint = places(spark, "jobs")
    kind = F.col("event_type")
    status = F.when(kind == "click", "running").when(kind == "purchase", "done").when(kind == "error", "error").otherwise("queued")
    events = J.table_stream(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", status.alias("status"), F.when(F.col("value") > 20, "Just a moment").otherwise("timeout").alias("error"))
    J.stream_job_status(events, "user_id", path, checkpoint).awaitTermination()
    newest = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    now = F.lit(newest).cast("timestamp_ntz") + F.expr("INTERVAL 1 MINUTE")
    return J.job_status_at(spark.read.parquet(path), "user_id", now)


@query("t3_stream_memory", f"""
WITH p AS (SELECT md5(trim(text, {STRIP})) AS raw_hash, 'T' || conv_id || '-' || turn AS t, conv_id * 1000 + turn AS seen_at, role FROM conversations WHERE length(text) > 5)
SELECT raw_hash, arg_max(t, seen_at) AS translated_text, arg_max(role, seen_at) AS project_scope, min(seen_at) AS first_at, max(seen_at) AS last_at, count(*) AS hit_count
FROM p GROUP BY raw_hash""")
def stream_memory(spark, sf_dir):
    path, checkpoint = places(spark, "memory")
    pairs = J.table_stream(spark, sf_dir, "conversations").select(
        F.col("text").alias("raw_text"), F.concat(F.lit("T"), "conv_id", F.lit("-"), "turn").alias("refined_translation"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seen_at"), "role")
    J.stream_memory(pairs, "role", path, checkpoint).awaitTermination()
    return J.memory_from_log(spark.read.parquet(path)).drop("raw_text")


@query("t4_stream_new_urls", """
SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages
WHERE regexp_replace(url, '[?#].*$', '') NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 3 = 0)""")
def stream_new_urls(spark, sf_dir):
    path, checkpoint = places(spark, "urls")
    plain = F.regexp_replace("url", "[?#].*$", "").alias("url")
    known = table(spark, sf_dir, "pages").filter("page_id % 3 = 0").select(plain)
    J.stream_new_urls(J.table_stream(spark, sf_dir, "pages").select(plain), known, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query("t5_stream_progress", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_progress(spark, sf_dir):
    path, checkpoint = places(spark, "progress")
    events = J.table_stream(spark, sf_dir, "events").select("user_id", "event_type")
    J.stream_progress(events, ["user_id", "event_type"], path, checkpoint).awaitTermination()
    return J.progress_from_log(spark.read.parquet(path), ["user_id", "event_type"])


@query("t5_stream_hourly", """
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_hourly(spark, sf_dir):
    path, checkpoint = places(spark, "hourly")
    # Event time is an instant: the naive column is read in the session zone and given back as it was.
    events = J.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    J.start_append(J.hourly_counts(events), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("t5_stream_live", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_live(spark, sf_dir):
    path, checkpoint = places(spark, "live")
    events = J.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    J.start_live(J.hourly_counts(events), path, checkpoint).awaitTermination()
    totals = J.live_totals(spark.read.parquet(path), ["hour", "event_type"])
    return totals.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("t5_stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, no
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, sf_dir):
    path, checkpoint = places(spark, "sessions")
    events = J.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    J.start_append(J.sessions(events, "user_id"), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn(
        "session_end", F.col("session_end").cast("timestamp_ntz"))
