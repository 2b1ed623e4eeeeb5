"""Schemas of the datasets and source files; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType(), containsNull=False)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, D, L, I, TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()

SONGS = _struct(
    id=S, musicbrainz_id=S, title=S, artist=S, album=S, duration_sec=D, bpm=D, musical_key=S,
    learned=VECTOR, handcrafted_raw=VECTOR, handcrafted_norm=VECTOR, mert=VECTOR,
    source=S, embedding_type=S, metadata_status=S, genre=S, release_year=I, deezer_id=L,
    youtube_url=S, created_at=TS)

FEEDBACK = _struct(
    id=S, query_song_id=S, result_song_id=S, rating=I, ip_hash=S, focus_active=S, ab_group=S,
    reason_tag=S, created_at=TS)

CLICKS = _struct(
    id=S, session_hash=S, query_song_id=S, result_song_id=S, result_rank=I, ab_group=S,
    action=S, created_at=TS)

JOB_EVENTS = _struct(
    job_id=S, status=S, progress=D, audio_path=S, duration_sec=D, result=S, last_error=S,
    updated_at=TS)

STATS = _struct(mean=VECTOR, std=VECTOR, dim=I, n_songs=L)

#: One line of a feature file; vectors arrive as JSON text.
FEATURE_LINE = _struct(
    _tid=S, title=S, artist=S, album=S, duration_sec=D, bpm=D, musical_key=S,
    learned_embedding=S, handcrafted_raw=S, handcrafted_norm=S, source=S, embedding_type=S,
    metadata_status=S, genre=S, release_year=I, _corrupt=S)

TRACK_LIST = _struct(
    deezer_id=L, title=S, artist=S, artist_id=L, album=S, duration=D, preview_url=S,
    release_year=I, genre_id=I)

GENRES_FILE = _struct(genre_id=I, title=S, top_level=I)
