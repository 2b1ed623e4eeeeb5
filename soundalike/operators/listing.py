"""Catalogue look-ups and selections (inventory B1-B5, B9, B16-B21, G3, G5)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.functions.text import ELECTRONIC_GENRE_IDS, TAG_GENRES, has_any_tag
from soundalike.functions.vectors import ColumnOrName, col

CARD = ("id", "title", "artist", "album", "bpm", "musical_key", "duration_sec", "genre", "deezer_id")


def contains_ignoring_case(c: ColumnOrName, needle: str) -> Column:
    """Literal, case-insensitive substring test; nothing in ``needle`` is a wildcard."""
    return F.lower(col(c)).contains(needle.lower())


def search(songs: DataFrame, q: str | None = None, genre: str | None = None, limit: int = 20,
           offset: int = 0) -> DataFrame:
    """Newest songs whose title or artist contains ``q``; ties by id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    out = songs
    if q:
        out = out.where(contains_ignoring_case("title", q) | contains_ignoring_case("artist", q))
    if genre:
        out = out.where(F.col("genre") == genre)
    order = (F.desc("created_at"), F.col("id"))
    return out.select(*CARD, "created_at").orderBy(*order).offset(offset).limit(limit)


def by_id(songs: DataFrame, song_id) -> DataFrame:
    """B2."""
    return songs.where(F.col("id") == song_id).select(*CARD)


def by_ids(songs: DataFrame, ids: DataFrame, first: int | None = None) -> DataFrame:
    """Songs of an id table (``id`` and, for ``first``, ``pos``)."""
    wanted = ids if first is None else ids.orderBy("pos").limit(first)
    return songs.join(wanted.select("id").distinct(), "id", "left_semi")


def count_songs(songs: DataFrame) -> DataFrame:
    """B4."""
    return songs.agg(F.count("*").alias("count"))


def genres(songs: DataFrame) -> DataFrame:
    """B5."""
    return songs.where(F.col("genre").isNotNull()).select("genre").distinct().orderBy("genre")


def not_failed(songs: DataFrame) -> DataFrame:
    """B9."""
    return songs.where(F.col("metadata_status") != "failed")


def year_passes(year: ColumnOrName, min_year: int | None) -> Column:
    """An unknown year passes."""
    if not min_year:
        return F.lit(True)
    return F.coalesce((col(year) >= min_year) | (col(year) == 0), F.lit(True))


def select_tracks(tracks: DataFrame, allowed: Iterable[str] | None = None,
                  excluded: Iterable[str] | None = None, min_year: int | None = None) -> DataFrame:
    """``genre`` (top) or ``sub_genre`` allowed, ``sub_genre`` not excluded, year rule."""
    out = tracks
    if allowed:
        names = list(allowed)
        out = out.where(F.coalesce(F.col("genre").isin(names), F.lit(False))
                        | F.coalesce(F.col("sub_genre").isin(names), F.lit(False)))
    if excluded:
        out = out.where(~F.coalesce(F.col("sub_genre").isin(list(excluded)), F.lit(False)))
    return out.where(year_passes("release_year", min_year))


def tag_selection(tracks: DataFrame, meta: DataFrame | None = None, min_year: int | None = None,
                  tags: Sequence[str] = tuple(TAG_GENRES)) -> DataFrame:
    """Every track with its ``outcome``: kept, no_tag or too_old."""
    out = tracks
    if meta is not None:
        out = out.join(meta.select("track_id", "release_year"), "track_id", "left")
    else:
        out = out.withColumn("release_year", F.lit(None).cast("int"))
    tagged = F.coalesce(has_any_tag("tags", tags), F.lit(False))
    return out.withColumn("outcome", F.when(~tagged, "no_tag")
                          .when(~year_passes("release_year", min_year), "too_old")
                          .otherwise("kept"))


def vector_backlog(songs: DataFrame, vec: str = "mert", limit: int | None = None) -> DataFrame:
    """Songs without ``vec`` that have an external id, oldest first."""
    out = (songs.where(F.col(vec).isNull() & F.col("deezer_id").isNotNull())
           .select("id", "deezer_id", "artist", "title", "created_at").orderBy("created_at", "id"))
    return out if limit is None else out.limit(limit)


def genre_backlog(songs: DataFrame, genre: str = "Electronic", limit: int | None = None
                  ) -> DataFrame:
    """Songs that still carry the fallback genre and have an external id."""
    out = (songs.where((F.col("genre") == genre) & F.col("deezer_id").isNotNull())
           .select("id", "deezer_id", "artist", "title", "genre", "created_at")
           .orderBy("created_at", "id"))
    return out if limit is None else out.limit(limit)


def electronic_artists(artists: DataFrame, top_tracks: DataFrame, albums: DataFrame,
                       ids: Sequence[int] = ELECTRONIC_GENRE_IDS) -> DataFrame:
    """Artists whose first top track is on an album of one of the genres.

    ``top_tracks``: ``artist_id, pos, album_id``; ``albums``: ``album_id, genre_id,
    genres array<struct<id,name>>``.
    """
    first = top_tracks.groupBy("artist_id").agg(F.min_by("album_id", "pos").alias("album_id"))
    wanted = F.array(*[F.lit(i) for i in ids])
    all_ids = F.concat(F.array(F.col("genre_id").cast("int")), F.coalesce(
        F.transform("genres", lambda g: g["id"].cast("int")), F.expr("array(cast(null as int))")))
    good = albums.where(F.arrays_overlap(all_ids, wanted)).select("album_id")
    return artists.join(first.join(good, "album_id", "left_semi"), "artist_id", "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName]) -> DataFrame:
    """First row per key in a given order."""
    w = Window.partitionBy(*keys).orderBy(*[col(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
