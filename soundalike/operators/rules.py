"""Row validation as reason columns (inventory B11-B15).

A rule is a name and a condition that holds for a bad row.  Works on batch and
streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains of the event, job and manifest columns.
REASON_TAGS = ("wrong_energy", "wrong_genre", "duplicate_version", "too_obvious",
               "bad_metadata", "other")
CLICK_ACTIONS = ("play", "spotify", "youtube", "playlist", "similar", "feedback_up",
                 "feedback_down")
JOB_STATES = ("queued", "processing", "completed", "failed")
AUDIO_TYPES = ("audio/mpeg", "audio/wav", "audio/x-wav", "audio/flac", "audio/ogg",
               "audio/x-flac", "audio/aac", "audio/mp4", "audio/x-m4a")
MAX_TEXT = 500
MAX_BATCH = 500
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_DURATION_SEC = 900.0

Rules = Mapping[str, Column]
c = F.col


def song_rules() -> Rules:
    """B11."""
    return {
        "title_missing": c("title").isNull(),
        "artist_missing": c("artist").isNull(),
        "title_too_long": F.length("title") > MAX_TEXT,
        "artist_too_long": F.length("artist") > MAX_TEXT,
    }


def feedback_rules() -> Rules:
    """B12."""
    return {
        "query_missing": c("query_song_id").isNull(),
        "result_missing": c("result_song_id").isNull(),
        "bad_rating": c("rating").isNull() | ~c("rating").isin(1, -1),
        "bad_reason_tag": c("reason_tag").isNotNull() & ~c("reason_tag").isin(*REASON_TAGS),
    }


def click_rules() -> Rules:
    """B13."""
    return {
        "session_too_long": c("session_hash").isNull() | (F.length("session_hash") > 20),
        "bad_action": c("action").isNull() | ~c("action").isin(*CLICK_ACTIONS),
        "bad_rank": c("result_rank").isNotNull() & ~c("result_rank").between(1, 200),
        "group_missing": c("ab_group").isNull(),
    }


def job_rules() -> Rules:
    """B14."""
    return {
        "bad_status": c("status").isNull() | ~c("status").isin(*JOB_STATES),
        "bad_progress": c("progress").isNull() | ~c("progress").between(0, 1),
        "bad_attempts": c("attempt_count").isNull() | (c("attempt_count") < 0),
    }


def effective_mime() -> Column:
    """A stream of bytes that starts with an ID3 tag counts as MPEG audio."""
    tagged = (c("mime") == "application/octet-stream") & c("header").startswith("ID3")
    return F.when(tagged, "audio/mpeg").otherwise(c("mime"))


def audio_rules() -> Rules:
    """Checks in the order they are made; the first one is the reason reported."""
    return {
        "too_large": c("size") > MAX_FILE_BYTES,
        "bad_type": effective_mime().isNull() | ~effective_mime().isin(*AUDIO_TYPES),
        "no_audio_stream": F.coalesce(c("n_streams"), F.lit(0)) < 1,
        "no_duration": c("duration_sec").isNull(),
        "too_long": c("duration_sec") > MAX_DURATION_SEC,
    }


def with_reasons(df: DataFrame, rules: Rules) -> DataFrame:
    """All broken rules of a row as ``reasons``, in rule order."""
    return df.withColumn("reasons", F.array_compact(F.array(
        *[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()])))


def validate(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``reasons``)."""
    marked = with_reasons(df, rules)
    good = marked.where(F.size("reasons") == 0).drop("reasons")
    return good, marked.where(F.size("reasons") > 0)


def oversized_batches(batches: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Batches with more rows than one import accepts."""
    return (batches.groupBy(batch_id).agg(F.count("*").alias("rows"))
            .where(F.col("rows") > MAX_BATCH))
