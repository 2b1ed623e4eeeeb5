"""Vote and click aggregates (inventory E2-E6, F2, F3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feedback_stats(votes: DataFrame) -> DataFrame:
    """Up, down, net and total votes of every (query, result) pair."""
    up = F.count_if(F.col("rating") == 1)
    down = F.count_if(F.col("rating") == -1)
    return votes.groupBy("query_song_id", "result_song_id").agg(
        up.alias("total_up"), down.alias("total_down"), (up - down).alias("net_score"),
        F.count("*").alias("total_votes"))


def top_pairs(stats: DataFrame, kind: str = "top", n: int = 20) -> DataFrame:
    """Best ("top") or worst ("flop") pairs; ties by ids."""
    net = F.desc("net_score") if kind == "top" else F.asc("net_score")
    return stats.orderBy(net, "query_song_id", "result_song_id").limit(n)


def genre_focus_weights(votes: DataFrame, songs: DataFrame, min_votes: int = 20) -> DataFrame:
    """Share of each focus category among a genre's positive votes.

    Votes are counted per (query song, focus) before they meet the catalogue, so
    a song or genre with a third of all votes is a handful of rows at the join.
    """
    counted = (votes.where(F.col("focus_active").isNotNull() & (F.col("rating") == 1))
               .groupBy("query_song_id", "focus_active").agg(F.count("*").alias("n")))
    genres = songs.where(F.col("genre").isNotNull()).select(
        F.col("id").alias("query_song_id"), "genre")
    per = (counted.join(genres, "query_song_id")
           .groupBy("genre", "focus_active").agg(F.sum("n").alias("vote_count")))
    return weights_from_votes(per, min_votes)


def weights_from_votes(per: DataFrame, min_votes: int = 20) -> DataFrame:
    """E4, last step: ``genre, focus_active, vote_count`` -> shares of well-voted genres.

    A genre has one row per focus category, so the window groups are tiny.
    """
    total = F.sum("vote_count").over(Window.partitionBy("genre"))
    return (per.withColumn("_total", total).where(F.col("_total") >= min_votes)
            .select("genre", F.col("focus_active").alias("focus_category"),
                    F.round(F.col("vote_count") / F.col("_total"), 4).alias("weight"),
                    "vote_count"))


def list_weights(weights: DataFrame, genre: str | None = None) -> DataFrame:
    """E5."""
    chosen = weights if genre is None else weights.where(F.col("genre") == genre)
    return chosen.orderBy("genre", F.desc("weight"), "focus_category")


def ab_summary(clicks: DataFrame) -> DataFrame:
    """Events, distinct sessions, first and last day per (group, action).

    Counted per session first: the distinct count then is a plain row count and
    no task holds the sessions of a large group.
    """
    per_session = clicks.groupBy("ab_group", "action", "session_hash").agg(
        F.count("*").alias("n"), F.min("created_at").alias("first"),
        F.max("created_at").alias("last"))
    return per_session.groupBy("ab_group", "action").agg(
        F.sum("n").alias("event_count"), F.count("session_hash").alias("unique_sessions"),
        F.to_date(F.min("first")).alias("first_event"),
        F.to_date(F.max("last")).alias("last_event"))
