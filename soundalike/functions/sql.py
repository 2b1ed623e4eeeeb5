"""SQL names for a few expressions, as temporary SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from soundalike.functions.harmonic import CAMELOT
from soundalike.functions.text import BRACKETED, VERSION_SUFFIX


def register(spark: SparkSession) -> None:
    """``cosine_similarity(a, b)``, ``base_title(t)`` and ``camelot(key)``."""
    length = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    scale = f"{length.format('a')} * {length.format('b')}"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)
        RETURNS DOUBLE RETURN CASE
          WHEN a IS NULL OR b IS NULL THEN NULL WHEN {scale} = 0 THEN 0D
          ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / ({scale}) END""")
    stripped = f"regexp_replace(regexp_replace(t, r'{BRACKETED}', ''), r'{VERSION_SUFFIX}', '')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION base_title(t STRING) RETURNS STRING
        RETURN lower(regexp_replace({stripped}, r'(?U)^\\s+|\\s+$', ''))""")
    wheel = ", ".join(f"'{key}', '{code}'" for key, code in CAMELOT.items())
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION camelot(key STRING) RETURNS STRING
        RETURN try_element_at(map({wheel}), key)""")


def register_search(spark: SparkSession, songs: str = "songs") -> None:
    """``find_similar_songs(query, match_count, exclude_id, min_bpm, max_bpm)`` over the view ``songs``.

    A table function: the songs of highest cosine similarity in the tempo range that have not failed, ties by id.
    The catalogue is scanned once; ranks are cut in each task before the narrow rows meet.
    """
    register(spark)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION find_similar_songs(query ARRAY<DOUBLE>, match_count INT DEFAULT 20,
          exclude_id BIGINT DEFAULT NULL, min_bpm DOUBLE DEFAULT 0, max_bpm DOUBLE DEFAULT 999)
        RETURNS TABLE (id BIGINT, title STRING, artist STRING, bpm DOUBLE, similarity DOUBLE, rank BIGINT)
        RETURN SELECT id, title, artist, bpm, similarity, CAST(rank AS BIGINT) FROM (
          SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM (
            SELECT s.id, s.title, s.artist, s.bpm, round(cosine_similarity(s.learned, query), 12) AS similarity
            FROM {songs} s WHERE s.bpm BETWEEN min_bpm AND max_bpm AND s.metadata_status <> 'failed'
              AND size(s.learned) = size(query) AND (exclude_id IS NULL OR s.id <> exclude_id)))
        WHERE rank <= match_count""")
