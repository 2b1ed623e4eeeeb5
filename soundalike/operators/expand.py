"""Growing the catalogue from an artist graph (inventory B21, F14, H4, J9, J15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundalike.functions.text import nonempty
from soundalike.operators.listing import electronic_artists, first_per_key
from soundalike.session import cut


def resolve_artists(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per name the first candidate of equal name (ignoring case), else the first.

    ``names``: ``name``; ``candidates``: ``query_name, pos, artist_id, artist_name``.
    """
    differs = F.lower("artist_name") != F.lower("query_name")
    best = candidates.groupBy("query_name").agg(F.min_by(
        F.struct("artist_id", "artist_name"),
        F.struct(F.coalesce(differs, F.lit(True)), F.col("pos"))).alias("b"))
    return (names.join(best, F.col("name") == F.col("query_name"), "left")
            .select("name", F.col("b.artist_id").alias("artist_id"),
                    F.col("b.artist_name").alias("artist_name")))


def _first(listed: DataFrame, n: int | None) -> DataFrame:
    return listed if n is None else listed.where(F.col("pos") <= n)


def reach_artists(seeds: DataFrame, related: DataFrame, top_tracks: DataFrame, albums: DataFrame,
                  depth: int = 1, fan: int | None = None) -> DataFrame:
    """artists within ``depth`` steps of the seeds, each with its smallest ``depth``.

    Of an artist's related artists the first ``fan`` count, all of them without it.

    Seeds are never gated; a related artist must pass the genre gate.  One frontier
    join and one anti-join per round; rounds are checkpointed.
    """
    edges = _first(related, fan).select("artist_id", "related_id")
    targets = edges.select(F.col("related_id").alias("artist_id")).distinct()
    gate = electronic_artists(targets, top_tracks, albums)
    seen = cut(seeds.select("artist_id").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        front = seen.where(F.col("depth") == step - 1).select("artist_id")
        fresh = (front.join(edges, "artist_id").select(F.col("related_id").alias("artist_id"))
                 .distinct().join(seen, "artist_id", "left_anti")
                 .join(gate, "artist_id", "left_semi")
                 .withColumn("depth", F.lit(step)))
        seen = cut(seen.unionByName(fresh))
    return seen


def expand_catalog(seeds: DataFrame, related: DataFrame, top_tracks: DataFrame, albums: DataFrame,
                   depth: int = 1, top: int | None = None, fan: int | None = None) -> DataFrame:
    """Tracks with a preview of all reached artists, each track once.

    ``top_tracks``: ``artist_id, pos, track_id, title, album_id, preview``;
    ``related``: ``artist_id, pos, related_id``.  A track listed for several
    artists goes to the one reached first (depth, then artist id).
    """
    artists = reach_artists(seeds, related, top_tracks, albums, depth, fan)
    listed = _first(top_tracks, top).where(nonempty("preview").isNotNull()
                              & F.col("track_id").isNotNull())
    return first_per_key(listed.join(artists, "artist_id"), ["track_id"],
                         ["depth", "artist_id", "pos"])


def new_tracks_of_artist(artists: DataFrame, top_tracks: DataFrame, songs: DataFrame,
                         per_artist: int | None = None) -> DataFrame:
    """J9, one-artist form: top tracks with a preview that the catalogue does not have yet."""
    listed = _first(top_tracks, per_artist).join(
        artists.select("artist_id"), "artist_id", "left_semi").where(nonempty("preview").isNotNull())
    known = songs.where(F.col("deezer_id").isNotNull()).select(
        F.col("deezer_id").alias("track_id"))
    return listed.join(known, "track_id", "left_anti")
