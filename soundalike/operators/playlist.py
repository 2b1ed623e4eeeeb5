"""Session history, playlists and mixes (inventory G4, G6, I25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundalike.functions.harmonic import round_half_up

PAD, WIDTH, HEIGHT = 20.0, 400.0, 80.0
#: Positions of one piece of a playlist's text.
CHUNK = 500


def recent_per_session(clicks: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` events of every session (cut per task before the shuffle)."""
    w = Window.partitionBy("session_hash").orderBy(F.desc("created_at"), F.desc("id"))
    return clicks.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def playlist_flow(entries: DataFrame, min_range: float = 10.0) -> DataFrame:
    """Tempo and intensity of every position, and both scaled to 0..1 within the playlist.

    ``entries``: ``playlist_id, position, bpm, intensity``.  A missing tempo counts
    0; the range is at least ``min_range``.  Bounds are aggregated and joined back,
    so a playlist with very many entries is not one window.
    """
    bpm = F.coalesce("bpm", F.lit(0.0))
    bounds = entries.groupBy("playlist_id").agg(
        F.greatest(F.max(bpm), F.lit(1.0)).alias("max_bpm"),
        F.min(F.when(bpm > 0, bpm)).alias("_min"), F.count("*").alias("entries"))
    bounds = bounds.withColumn("min_bpm", F.least(F.coalesce("_min", "max_bpm"), "max_bpm")).drop(
        "_min")
    spread = F.greatest(F.col("max_bpm") - F.col("min_bpm"), F.lit(min_range))
    at = F.when(F.col("entries") > 1, (F.col("position") - 1) / F.nullif(
        F.col("entries") - 1, F.lit(0))).otherwise(F.lit(0.0))
    return entries.join(bounds, "playlist_id").select(
        "playlist_id", "position", bpm.alias("bpm"),
        F.coalesce("intensity", F.lit(0.0)).alias("intensity"), "min_bpm", "max_bpm",
        at.alias("x"), ((bpm - F.col("min_bpm")) / spread).alias("bpm_level"))


def flow_points(flow: DataFrame, width: float = WIDTH, height: float = HEIGHT,
                pad: float = PAD) -> DataFrame:
    """Plot coordinates of the two curves."""
    plot_w, plot_h = width - 2 * pad, height - pad
    return flow.select(
        "playlist_id", "position", (pad + F.col("x") * plot_w).alias("x"),
        (pad + (1 - F.col("bpm_level")) * plot_h).alias("bpm_y"),
        (pad + (1 - F.col("intensity")) * plot_h).alias("intensity_y"))


def playlist_lines(entries: DataFrame) -> DataFrame:
    """``n. artist — title | bpm | key`` for every entry."""
    bpm = F.when(F.coalesce("bpm", F.lit(0.0)) != 0,
                 F.concat(round_half_up("bpm").cast("string"), F.lit(" BPM")))
    key = F.when(F.coalesce("musical_key", F.lit("")) != "", F.col("musical_key"))
    head = F.concat(F.col("position").cast("string"), F.lit(". "), F.col("artist"),
                    F.lit(" — "), F.col("title"))
    return entries.select("playlist_id", "position", F.concat_ws(" | ", head, bpm, key).alias("line"))


def playlist_text(entries: DataFrame, size: int = CHUNK) -> DataFrame:
    """The lines of a playlist, joined in order, in numbered pieces of ``size`` positions.

    ``playlist_id, chunk, text``.  A playlist with a third of all entries is many groups of bounded size; a list of
    up to ``size`` entries is one piece.
    """
    lines = playlist_lines(entries).withColumn("chunk", F.floor((F.col("position") - 1) / size).cast("long"))
    return lines.groupBy("playlist_id", "chunk").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "line"))), lambda e: e["line"]),
        "\n").alias("text"))
