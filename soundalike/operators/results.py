"""Annotations of result lists (inventory D12-D15, D17, E21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.functions import harmonic as H
from soundalike.functions.radar import AXES, radar_scores
from soundalike.functions.vectors import ColumnOrName, col


def harmonic(results: DataFrame, songs: DataFrame) -> DataFrame:
    """Camelot code, key compatibility and tempo fit of (query song, result) rows.

    ``query_id`` of ``results`` is the id of the query song.
    """
    meta = songs.select("id", "musical_key", "bpm")
    q = meta.select(*[F.col(c).alias(f"q_{c}") for c in meta.columns])
    joined = (results.join(meta, "id")
              .join(q, F.col("query_id") == F.col("q_id")).drop("q_id"))
    return joined.select(
        *results.columns,
        H.camelot("musical_key").alias("camelot"),
        H.harmonic_compatibility("q_musical_key", "musical_key").alias("compatibility"),
        H.bpm_match("q_bpm", "bpm").alias("bpm_match"),
        H.bpm_difference("q_bpm", "bpm").alias("bpm_diff"))


def display_score(results: DataFrame) -> DataFrame:
    """Scores of one list spread over 60-99."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("similarity").over(w), F.max("similarity").over(w)
    s = F.col("similarity")
    spread = H.round_half_up(60 + (s - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 39)
    return (results.withColumn("_lo", lo).withColumn("_hi", hi)
            .withColumn("display", F.when(F.col("_hi") - F.col("_lo") > 0.001, spread)
                        .otherwise(H.round_half_up(s * 100)))
            .drop("_lo", "_hi"))


def similarity_label(score: ColumnOrName,
                     labels: Sequence[str] = ("very similar", "similar", "distant")) -> Column:
    """D14."""
    s = col(score)
    return F.when(s >= 0.9, labels[0]).when(s >= 0.7, labels[1]).otherwise(labels[2])


def radar(songs: DataFrame, vec: str = "handcrafted_norm") -> DataFrame:
    """``id`` and five scores for every song that has a feature vector."""
    scores = radar_scores(vec)
    return songs.where(F.size(vec) > 0).select(
        "id", *[scores[a].alias(a) for a in AXES])


def explain(results: DataFrame, radar_table: DataFrame,
            axes: Sequence[str] = AXES) -> DataFrame:
    """Per axis how far query song and result are apart, and the axes that are alike."""
    r = radar_table.select("id", *[F.col(a).alias(f"r_{a}") for a in axes])
    q = radar_table.select(F.col("id").alias("query_id"), *[F.col(a).alias(f"q_{a}") for a in axes])
    # Rounded so that a difference of exactly 0.15 between 3-digit scores is not noise.
    gap = {a: F.round(F.abs(F.col(f"q_{a}") - F.col(f"r_{a}")), 9) for a in axes}
    return results.join(r, "id").join(q, "query_id").select(
        *results.columns,
        *[F.when(gap[a] < 0.15, "similar").when(gap[a] < 0.35, "medium").otherwise("less").alias(a)
          for a in axes],
        F.array_compact(F.array(*[F.when(gap[a] < 0.15, a) for a in axes])).alias("alike"))


def filter_results(results: DataFrame, songs: DataFrame, *, min_bpm: float | None = None,
                   max_bpm: float | None = None, codes: Sequence[str] | None = None,
                   min_sim: float | None = None) -> DataFrame:
    """Keep results in a tempo range, in given Camelot codes, above a similarity."""
    meta = songs.select("id", "bpm", H.camelot("musical_key").alias("_code"))
    out = results.join(meta, "id")
    if min_bpm is not None:
        out = out.where(F.col("bpm") >= min_bpm)
    if max_bpm is not None:
        out = out.where(F.col("bpm") <= max_bpm)
    if codes is not None:
        out = out.where(F.col("_code").isin(*codes))
    if min_sim is not None:
        out = out.where(F.col("similarity") >= min_sim)
    return out.select(*results.columns)
