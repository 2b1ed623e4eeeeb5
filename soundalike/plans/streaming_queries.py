"""Registered streaming queries: the tables are read as streams to their end, then the sink is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundalike.operators import feedback as FB
from soundalike.operators import rules as RU
from soundalike.plans.catalog_queries import STATE_SQL, STATS_SQL, TIME, reasons_sql, work_list
from soundalike.plans.registry import query
from soundalike.plans.retrieval_queries import FINAL, WEIGHTS_CTE
from soundalike.session import scratch_path
from soundalike.sources import views as V
from soundalike.streaming import jobs as ST


class _Reader:
    def __init__(self, spark):
        self._spark = spark

    def parquet(self, path: str):
        # A stream source has to be a folder or a pattern; ``.parque[t]`` is the one file.
        return ST.read_table_stream(self._spark, f"{path[:-1]}[{path[-1]}]")


class _streams:  # noqa: N801 - stands in for a session
    """Lets the domain views read tables as streams."""

    def __init__(self, spark):
        self.read = _Reader(spark)


def _paths(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def _versions(spark, df, name, keys, mode="update"):
    out, cp = _paths(spark, name)
    ST.write_versions(df, out, cp, mode, keys).awaitTermination()
    return ST.current(spark, out, keys)


@query("k1_feedback_intake", """
SELECT id, rating::BIGINT AS rating, substr(sha256(ip), 1, 16) AS ip_hash FROM feedback""")
def k1(spark, sf):
    stream = ST.feedback_events(V.feedback(_streams(spark), sf))
    good, cp = _paths(spark, "k1")
    ST.ingest_events(stream, RU.feedback_rules(), good, good + "-bad", cp).awaitTermination()
    return spark.read.parquet(good).select("id", F.col("rating").cast("long").alias("rating"),
                                           "ip_hash")


@query("k2_click_quarantine", "SELECT * FROM (SELECT id, " + reasons_sql(
    ("bad_action", "action = 'signup'"), ("bad_rank", "result_rank NOT BETWEEN 1 AND 200"))
    + " FROM clicks) WHERE reasons <> ''")
def k2(spark, sf):
    good, cp = _paths(spark, "k2")
    bad = good + "-bad"
    ST.ingest_events(V.clicks(_streams(spark), sf), RU.click_rules(), good, bad, cp).awaitTermination()
    return spark.read.parquet(bad).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("k3_feedback_stats_stream", STATS_SQL)
def k3(spark, sf):
    votes = V.feedback(_streams(spark), sf)
    return _versions(spark, ST.stream_feedback_stats(votes), "k3",
                     ["query_song_id", "result_song_id"])


@query("k3_genre_weights_stream", "WITH " + WEIGHTS_CTE + " SELECT * FROM weights")
def k3_weights(spark, sf):
    votes = V.feedback(_streams(spark), sf)
    counts = ST.stream_focus_votes(votes, V.vectors(spark, sf))
    return FB.weights_from_votes(_versions(spark, counts, "k3w", ["genre", "focus_active"]))


@query("k4_job_state_stream", "WITH " + STATE_SQL + """
SELECT job_id, status, progress, result, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM state""")
def k4(spark, sf):
    state = ST.stream_job_state(V.job_events(_streams(spark), sf))
    return _versions(spark, state, "k4", ["job_id"]).select(
        "job_id", "status", "progress", "result",
        F.date_format("updated_at", TIME).alias("updated_at"))


@query("k5_stalled_stream", "WITH " + STATE_SQL + """, last AS (SELECT max(updated_at) AS t FROM state)
SELECT job_id::VARCHAR AS job_id, coalesce(status = 'processing' AND updated_at
    + INTERVAL 300 SECOND < t, false) AS stalled,
  CASE WHEN status = 'processing' AND updated_at + INTERVAL 300 SECOND < t THEN 'failed' ELSE status
  END AS status FROM state, last""")
def k5(spark, sf):
    """Jobs silent on event time once the stream has been read to its end."""
    events = V.job_events(_streams(spark), sf).select(
        F.col("job_id").cast("string").alias("job_id"), "status", "seq", "updated_at")
    return _versions(spark, ST.stream_stalled_jobs(events, clock="event", watermark="0 seconds"), "k5", ["job_id"]).select(
        "job_id", "status", "stalled")


@query("k7_recommend_stream", """
WITH pairs AS (
  SELECT a.id AS query_id, b.id, b.bpm,
    round(list_cosine_similarity(a.learned, b.learned), 12) AS similarity
  FROM songs a CROSS JOIN songs b),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pr
  FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM pool WHERE pr <= 100 AND id <> query_id AND bpm BETWEEN 0 AND 999)
""" + FINAL + "r WHERE rank <= 20")
def k7(spark, sf):
    out, cp = _paths(spark, "k7")
    arriving = V.table(_streams(spark), sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("learned"))
    catalogue = ST.Refreshed(lambda: V.vectors(spark, sf))
    ST.stream_recommend(arriving, catalogue, out, cp).awaitTermination()
    return spark.read.parquet(out).select(
        "query_id", "id", F.round("similarity", 6).alias("similarity"),
        F.col("rank").cast("long").alias("rank"))


@query("j10_feed_stream", """
SELECT p_partkey + 1200 AS deezer_id, CASE WHEN (p_partkey + 1200) IN (
    SELECT deezer_id FROM songs WHERE deezer_id IS NOT NULL) THEN 'skipped'
  WHEN p_partkey % 4 <> 0 THEN 'queued' ELSE 'failed' END AS outcome FROM part""")
def j10_stream(spark, sf):
    """The ledger of a work list that is read to its end as a stream."""
    out, cp = _paths(spark, "j10")
    ST.stream_feed(work_list(_streams(spark), sf), V.vectors(spark, sf), out, out + "-ledger", cp).awaitTermination()
    return ST.current(spark, out + "-ledger", ["deezer_id"]).select("deezer_id", "outcome")


@query("k8_events_per_source", """
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start,
  substr(sha256(ip), 1, 16) AS ip_hash, count(*) AS events FROM feedback GROUP BY ALL""")
def k8(spark, sf):
    votes = ST.feedback_events(V.feedback(_streams(spark), sf))
    counts = ST.stream_windowed_counts(votes, ["ip_hash"], "10 minutes")
    return _versions(spark, counts, "k8", ["window_start", "window_end", "ip_hash"]).select(
        F.date_format("window_start", TIME).alias("window_start"), "ip_hash", "events")


@query("k9_ab_windows", """
SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, ab_group, action,
  count(*) AS event_count, count(DISTINCT session_hash) AS unique_sessions,
  min(created_at)::DATE::VARCHAR AS first_event, max(created_at)::DATE::VARCHAR AS last_event
FROM clicks GROUP BY ALL""")
def k9(spark, sf):
    sessions = ST.stream_ab_sessions(V.clicks(_streams(spark), sf), "10 minutes")
    return ST.ab_windows(_versions(spark, sessions, "k9", ST.AB_KEYS)).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "ab_group", "action", "event_count",
        "unique_sessions", F.col("first_event").cast("string").alias("first_event"),
        F.col("last_event").cast("string").alias("last_event"))


@query("k9_sessions", """
WITH g AS (SELECT session_hash, created_at, CASE WHEN created_at < lag(created_at) OVER w
    + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM clicks WINDOW w AS (PARTITION BY session_hash ORDER BY created_at)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_hash ORDER BY created_at
    ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT session_hash, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events
FROM s GROUP BY session_hash, n""")
def k9_sessions(spark, sf):
    """Visits come out as they close; a mark after the last event closes the rest."""
    out, cp = _paths(spark, "k9s")
    ends = out + "-ends"

    def run():
        visits = ST.stream_sessions(V.clicks(_streams(spark), sf), "10 minutes", ends=ST.end_marks(spark, ends))
        ST.write_versions(visits, out, cp, "append").awaitTermination()
    run()
    ST.mark_end(spark, ends)
    run()
    return spark.read.parquet(out).select(
        "session_hash", F.date_format("started", TIME).alias("started"), "events")


@query("k6_weights_in_stream", "WITH " + WEIGHTS_CTE + """
SELECT c.id, w.focus_category, w.weight FROM clicks c JOIN songs s ON s.id = c.query_song_id
JOIN weights w ON w.genre = s.genre""")
def k6(spark, sf):
    """Clicks joined per micro-batch with the weight table as it is at that time."""
    out, cp = _paths(spark, "k6")
    table = scratch_path(spark, "weights")
    FB.genre_focus_weights(V.feedback(spark, sf), V.vectors(spark, sf)).write.parquet(table)
    weights = ST.Refreshed(lambda: spark.read.parquet(table))
    genres = V.vectors(spark, sf).select(F.col("id").alias("query_song_id"), "genre")

    def join(batch, value):
        return (batch.join(genres, "query_song_id").join(value, "genre")
                .select("id", "focus_category", "weight"))

    ST.stream_beside(V.clicks(_streams(spark), sf), weights, join, out, cp).awaitTermination()
    return spark.read.parquet(out).select("id", "focus_category", "weight")
