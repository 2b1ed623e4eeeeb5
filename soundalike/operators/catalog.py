"""Catalogue building and maintenance (inventory A10, E10, F4-F12, H3, H4, H6, I10, I26, J1-J8, J10, J12, J13).

Jobs read, join and return changed rows or a new snapshot; nothing is updated in
place.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundalike.functions import text as X
from soundalike.operators.listing import first_per_key, genre_backlog, year_passes
from soundalike.operators.rules import song_rules, validate
from soundalike.session import cut

# Titles of songs without metadata.
FALLBACK_TITLE = "FMA Track "
FALLBACK_TAGGED_TITLE = "Jamendo "
FALLBACK_UPLOAD_TITLE = "Upload "


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, or without one the smallest of the other columns.

    Update joins go through this, so a repeated key never multiplies the rows it is joined to.
    """
    if order:
        return first_per_key(df, list(keys), list(order))
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


# --------------------------------------------------------------- metadata to songs

def genre_parents(genres: DataFrame) -> DataFrame:
    """``title, top`` of every genre; a genre with an unknown parent is its own top.

    ``genres``: ``genre_id, title, top_level``.  Two genres of one title: the last
    id in the file order wins, taken as the highest id.
    """
    top = genres.select(F.col("genre_id").alias("top_level"), F.col("title").alias("top"))
    named = genres.join(top, "top_level", "left")
    return named.groupBy("title").agg(
        F.max_by(F.coalesce("top", "title"), "genre_id").alias("top"))


def track_genres(tracks: DataFrame, parents: DataFrame, titles: str = "genre_titles") -> DataFrame:
    """The first listed genre that is known -> ``sub_genre`` and ``genre`` (its top).

    ``parents``: ``title, top``.  One row per track that has a known genre.
    """
    listed = tracks.select("track_id", F.posexplode(titles).alias("pos", "title"))
    return (listed.join(parents, "title").groupBy("track_id")
            .agg(F.min_by(F.struct("title", "top"), "pos").alias("g"))
            .select("track_id", F.col("g.title").alias("sub_genre"), F.col("g.top").alias("genre")))


def track_metadata(tracks: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """A2: typed metadata of the raw track table."""
    typed = tracks.select(
        "track_id", "track_title", "artist_name", "album_title",
        X.parse_duration("track_duration").alias("duration_sec"),
        X.genre_titles("track_genres").alias("genre_titles"),
        X.release_year("track_date_recorded", "track_date_created").alias("release_year"))
    if parents is None:
        return typed.withColumn("sub_genre", F.lit(None).cast("string")).withColumn(
            "genre", F.lit(None).cast("string"))
    return typed.join(track_genres(typed, parents), "track_id", "left")


def metadata_defaults(tracks: DataFrame) -> DataFrame:
    """A3: the same source with placeholder title and artist."""
    return tracks.select(
        "track_id",
        F.coalesce(X.nonempty("track_title"),
                   F.concat(F.lit("Track "), F.col("track_id").cast("string"))).alias("title"),
        F.coalesce(X.nonempty("artist_name"), F.lit("Unknown")).alias("artist"),
        X.nonempty("album_title").alias("album"),
        X.parse_duration("track_duration").alias("duration_sec"))


def _measured(found: Column, *otherwise: Column) -> Column:
    """The measured duration unless it is missing or zero, else the listed one."""
    return F.coalesce(F.nullif(found.cast("double"), F.lit(0.0)),
                      *[c.cast("double") for c in otherwise])


FEATURES = ("bpm", "musical_key", "learned", "handcrafted_raw")


def _song_columns(source: str, genre: Column, title: Column, artist: Column, album: Column,
                  duration: Column, status: Column) -> list[Column]:
    return [
        title.alias("title"), artist.alias("artist"), album.alias("album"),
        duration.alias("duration_sec"), F.col("bpm"),
        F.coalesce("musical_key", F.lit("Unknown")).alias("musical_key"),
        F.col("learned"), F.col("handcrafted_raw"), F.lit(source).alias("source"),
        F.lit("real").alias("embedding_type"), status.alias("metadata_status"),
        genre.alias("genre"), F.col("release_year")]


def _last_row(meta: DataFrame) -> DataFrame:
    if "row_no" not in meta.columns:
        return one_per_key(meta, ["track_id"])
    rest = [c for c in meta.columns if c != "track_id"]
    return meta.groupBy("track_id").agg(F.max_by(F.struct(*rest), "row_no").alias("_r")).select("track_id", "_r.*")


def _status(title: str) -> Column:
    return F.when(X.nonempty(title).isNull(), "partial").otherwise("complete")


def fma_songs(features: DataFrame, meta: DataFrame) -> DataFrame:
    """Features of tracks with their metadata; rows without metadata get defaults.

    ``features``: ``track_id, duration`` and the feature columns.  Of several metadata rows of one
    track the last one counts (``row_no``, where there is one).
    """
    both = features.join(_last_row(meta), "track_id", "left")
    fallback = F.concat(F.lit(FALLBACK_TITLE), F.col("track_id").cast("string"))
    return both.select("track_id", *_song_columns(
        "fma", F.col("genre"), F.coalesce(X.nonempty("track_title"), fallback),
        F.coalesce(X.nonempty("artist_name"), F.lit("Unknown")), X.nonempty("album_title"),
        _measured(F.col("duration"), F.col("duration_sec")), _status("track_title")))


def jamendo_songs(features: DataFrame, meta: DataFrame, tags: DataFrame) -> DataFrame:
    """I26 for the tagged source.  ``tags``: ``track_id, tag_duration, genre``."""
    both = features.join(_last_row(meta), "track_id", "left").join(
        one_per_key(tags, ["track_id"]), "track_id", "left")
    fallback = F.concat(F.lit(FALLBACK_TAGGED_TITLE), F.col("track_id").cast("string"))
    return both.select("track_id", *_song_columns(
        "jamendo", F.coalesce("genre", F.lit(X.FALLBACK_GENRE)),
        F.coalesce(X.nonempty("title"), fallback),
        F.coalesce(X.nonempty("artist"), F.lit("Unknown")), X.nonempty("album"),
        _measured(F.col("duration"), F.nullif("tag_duration", F.lit(0.0))), _status("title")))


def crawled_songs(features: DataFrame, tracks: DataFrame) -> DataFrame:
    """I26 for crawled tracks; genre ids map to the coarse labels."""
    both = features.join(tracks, "deezer_id")
    genre = X.genre_label("genre_id", X.COARSE_GENRE_LABELS)
    return both.select("deezer_id", *_song_columns(
        "deezer", genre, F.coalesce("title", F.lit("Unknown")),
        F.coalesce("artist", F.lit("Unknown")), X.nonempty("album"),
        _measured(F.col("feature_duration"), F.col("duration")), F.lit("complete")))


def unify(*sources: DataFrame) -> DataFrame:
    """Sources with different columns in one schema."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


# -------------------------------------------------------------------- import, feed

def pending(work: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Work that is not in ``processed``."""
    return work.join(processed.select(key), key, "left_anti")


def with_import_defaults(rows: DataFrame) -> DataFrame:
    """Defaults of optional columns."""
    out = rows
    for name, value in (("source", "unknown"), ("embedding_type", "real"),
                        ("metadata_status", "complete")):
        base = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(base, F.lit(value)))
    return out


def import_new(existing: DataFrame, incoming: DataFrame, *, keys: Sequence[str] = ("deezer_id",),
               order: Sequence[str] = ("seq",)) -> DataFrame:
    """The incoming rows to append.  A row that repeats a unique key is left out.

    The first row per key (by ``order``) wins; with several keys a row is only blocked by
    a row that is itself taken.  A NULL key never conflicts and such rows take no part in a
    shuffle on that key.
    """
    rows = with_import_defaults(incoming)
    for key in keys:
        keyless = rows.where(F.col(key).isNull())
        keyed = rows.where(F.col(key).isNotNull())
        if len(keys) == 1:
            keyed = first_per_key(keyed, [key], order)
        rows = keyless.unionByName(pending(keyed, existing.where(F.col(key).isNotNull()), key))
    return rows if len(keys) == 1 else _accepted(rows, keys, order)


def _accepted(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that an insert loop in ``order`` would take: only an accepted row blocks another one.

    Every round takes the rows that come first under all their keys and removes what conflicts with them.
    The first row that is left is always taken, and chains of conflicts are short, so rounds are few.
    """
    rest = cut(rows.withColumn("_place", F.struct(*order, F.monotonically_increasing_id())))
    taken = None
    while not rest.isEmpty():
        head = rest
        for key in keys:
            lead = rest.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_place").alias("_lead"))
            head = head.join(lead, key, "left").where(
                F.col("_lead").isNull() | (F.col("_lead") == F.col("_place"))).drop("_lead")
        head = cut(head.select(*rest.columns))
        taken = head if taken is None else taken.unionByName(head)
        rest = rest.join(head.select("_place"), "_place", "left_anti")
        for key in keys:
            rest = rest.join(head.where(F.col(key).isNotNull()).select(key), key, "left_anti")
        rest = cut(rest.select(*head.columns))
    return (rest if taken is None else taken).drop("_place").select(*rows.columns)


def import_report(existing: DataFrame, incoming: DataFrame, **kw) -> DataFrame:
    """Rows attempted, rejected by validation, skipped as known, and inserted."""
    good, bad = validate(incoming, song_rules())
    new = import_new(existing, good, **kw)
    parts = (incoming.select(F.lit("attempted").alias("what"))
             .unionByName(bad.select(F.lit("rejected").alias("what")))
             .unionByName(good.select(F.lit("valid").alias("what")))
             .unionByName(new.select(F.lit("inserted").alias("what"))))
    return parts.agg(*[F.count_if(F.col("what") == w).alias(w)
                       for w in ("attempted", "rejected", "inserted")],
                     (F.count_if(F.col("what") == "valid")
                      - F.count_if(F.col("what") == "inserted")).alias("skipped"))


def feed(work: DataFrame, existing: DataFrame, processed: DataFrame | None = None,
         limit: int | None = None, key: str = "deezer_id", order: str = "pos") -> DataFrame:
    """Every item of the work list with its ``outcome``.

    processed (earlier run), skipped (already in the catalogue), failed (no
    preview to analyse), beyond_limit, or queued.
    """
    seen = F.lit(False)
    rows = work
    if processed is not None:
        done = processed.select(key).distinct().withColumn("_done", F.lit(True))
        rows = rows.join(done, key, "left")
        seen = F.coalesce("_done", F.lit(False))
    todo = rows.withColumn("_seen", seen)
    if limit is not None:
        # Items are told apart by position and key together; either may be missing or repeated.
        chosen = (todo.where(~F.col("_seen")).select(F.col(order).alias("_pos"), F.col(key).alias("_key"))
                  .distinct().orderBy(F.col("_pos").asc_nulls_last(), F.col("_key").asc_nulls_last())
                  .limit(limit).withColumn("_in", F.lit(True)))
        todo = todo.join(chosen, F.col(order).eqNullSafe(F.col("_pos"))
                         & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_pos", "_key")
    else:
        todo = todo.withColumn("_in", F.lit(True))
    known = existing.where(F.col(key).isNotNull()).select(key).distinct().withColumn(
        "_known", F.lit(True))
    todo = todo.join(known, key, "left")
    outcome = (F.when(F.col("_seen"), "processed")
               .when(F.col("_in").isNull(), "beyond_limit")
               .when(F.col("_known").isNotNull(), "skipped")
               .when(F.coalesce(X.nonempty("preview_url"), F.lit("")) == "", "failed")
               .otherwise("queued"))
    return todo.withColumn("outcome", outcome).select(*work.columns, "outcome")


# ------------------------------------------------------------------------- updates

def apply_genres(songs: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """Songs with new genres; the last update of an id counts."""
    last = updates.groupBy("id").agg(F.max_by(
        F.struct(F.col("genre").alias("genre")), order).alias("_u"))
    return (songs.join(last, "id", "left")
            .withColumn("genre", F.when(F.col("_u").isNotNull(), F.col("_u.genre"))
                        .otherwise(F.col("genre"))).drop("_u"))


def external_id_mapping(lines: DataFrame, order: Sequence[str] = ("file", "line")) -> DataFrame:
    """First line per external id, without blank titles or artists."""
    trimmed = lines.withColumn("title", X.strip(F.coalesce("title", F.lit("")))).withColumn(
        "artist", X.strip(F.coalesce("artist", F.lit(""))))
    usable = trimmed.where(F.col("deezer_id").isNotNull() & (F.col("title") != "")
                           & (F.col("artist") != ""))
    return first_per_key(usable, ["deezer_id"], order)


def backfill_external_id(songs: DataFrame, mapping: DataFrame,
                         order: Sequence[str] = ("file", "line")) -> DataFrame:
    """``id, deezer_id`` of the songs that get an external id by (title, artist).

    An id stays unique: it is not given out when a song has it already, a
    (title, artist) gets its first mapping, and of several songs the lowest id.
    """
    names = ["title", "artist"]
    free = pending(mapping, songs.where(F.col("deezer_id").isNotNull()), "deezer_id")
    one = first_per_key(free, names, order).select(*names, "deezer_id")
    target = (songs.where(F.col("deezer_id").isNull()).groupBy(*names)
              .agg(F.min("id").alias("id")))
    return target.join(one, names).select("id", "deezer_id")


def album_genres(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """``deezer_id, album_id, new_genre`` through the track's album."""
    labelled = one_per_key(albums.select("album_id", X.album_genre("genre_id", "genres").alias("g")), ["album_id"])
    of_track = one_per_key(tracks.select("deezer_id", "album_id"), ["deezer_id"])
    return (of_track.join(labelled, "album_id", "left")
            .select("deezer_id", "album_id",
                    F.coalesce("g", F.lit(X.FALLBACK_GENRE)).alias("new_genre")))


def backfill_genre(songs: DataFrame, tracks: DataFrame, albums: DataFrame,
                   limit: int | None = None) -> DataFrame:
    """The backlog with ``new_genre`` and ``outcome`` updated / unchanged / failed."""
    found = album_genres(tracks, albums)
    work = genre_backlog(songs, limit=limit).join(found, "deezer_id", "left")
    outcome = (F.when(F.col("album_id").isNull(), "failed")
               .when(F.col("new_genre") == X.FALLBACK_GENRE, "unchanged").otherwise("updated"))
    return work.withColumn("outcome", outcome).select(
        "id", "deezer_id", "genre", "new_genre", "outcome")


def update_vectors(songs: DataFrame, vectors: DataFrame, column: str = "mert",
                   processed: DataFrame | None = None) -> DataFrame:
    """Songs with the supplied ``vector`` where theirs is missing; processed ids are left.

    Of several vectors of one song the smallest counts.
    """
    new = one_per_key(vectors.where(F.col("vector").isNotNull()).select(
        "id", F.col("vector").alias("_new")), ["id"])
    if processed is not None:
        new = pending(new, processed, "id")
    return songs.join(new, "id", "left").withColumn(
        column, F.coalesce(column, "_new")).drop("_new")


def vector_outcomes(backlog: DataFrame, results: DataFrame, processed: DataFrame) -> DataFrame:
    """Skipped / no_preview / failed / extracted for every backlog row.

    ``results``: ``id, vector, error``.
    """
    done = processed.select("id").distinct().withColumn("_p", F.lit(True))
    best = results.groupBy("id").agg(F.min_by(
        F.struct("vector", "error"), F.struct(F.col("vector").isNull(), "error")).alias("_r"))
    rows = backlog.join(done, "id", "left").join(best.select("id", "_r.*"), "id", "left")
    outcome = (F.when(F.col("_p").isNotNull(), "skipped")
               .when(F.col("error") == "no_preview", "no_preview")
               .when(F.col("vector").isNull(), "failed").otherwise("extracted"))
    return rows.select("id", outcome.alias("outcome"))


# ------------------------------------------------------------------------ clean-up

def classify(songs: DataFrame, meta: DataFrame, keep: Iterable[str] = ("Electronic",),
             excluded: Iterable[str] = (), min_year: int | None = 2000) -> DataFrame:
    """Songs with their metadata and ``verdict`` keep / delete / unmatched.

    A song matches by the id in a placeholder title, else by exact title, the first
    metadata row (lowest ``row_no``).  ``meta``: ``track_id, track_title, genre,
    sub_genre, release_year, row_no``.
    """
    fields = F.struct("track_id", "genre", "sub_genre", "release_year")
    placeholder = F.concat(F.lit(FALLBACK_TITLE), F.col("track_id").cast("string"))
    by_title = (meta.groupBy(F.coalesce(X.nonempty("track_title"), placeholder).alias("title"))
                .agg(F.min_by(fields, "row_no").alias("_t")))
    by_id = meta.groupBy(F.col("track_id").alias("_tid")).agg(F.max_by(fields, "row_no").alias("_i"))
    number = F.regexp_extract("title", rf"^{FALLBACK_TITLE}(\d+)$", 1)
    both = (songs.withColumn("_tid", X.nonempty(number).cast("long"))
            .join(by_id, "_tid", "left").join(by_title, "title", "left"))
    m = F.coalesce("_i", "_t")
    both = both.withColumn("_m", m)
    drop_sub = list(excluded)
    allowed = F.coalesce(F.col("_m.genre").isin(list(keep)), F.lit(False))
    barred = F.coalesce(F.col("_m.sub_genre").isin(drop_sub), F.lit(False)) if drop_sub else F.lit(False)
    good = allowed & ~barred & year_passes("_m.release_year", min_year)
    verdict = (F.when(F.col("_m").isNull(), "unmatched").when(good, "keep").otherwise("delete"))
    return both.select(
        *[c for c in songs.columns], F.col("_m.track_id").alias("track_id"),
        F.col("_m.genre").alias("new_genre"), F.col("_m.release_year").alias("new_year"),
        verdict.alias("verdict"))


def cleanup(classified: DataFrame) -> DataFrame:
    """The songs that stay, tagged with genre and year."""
    kept = classified.where(F.col("verdict") == "keep")
    return kept.withColumn("genre", F.col("new_genre")).withColumn(
        "release_year", F.col("new_year")).drop("new_genre", "new_year", "verdict", "track_id")


def deletions_by_genre(classified: DataFrame) -> DataFrame:
    """Deleted songs per genre, most first."""
    return (classified.where(F.col("verdict") == "delete")
            .groupBy(F.coalesce(X.nonempty("new_genre"), F.lit("Unknown")).alias("genre"))
            .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "genre"))


# --------------------------------------------------------------------- enrichment

def enrich(uploads: DataFrame, resolved: DataFrame) -> DataFrame:
    """Uploads overlaid with resolved metadata, else placeholder title and artist.

    ``uploads``: ``job_id`` (text) and feature columns; ``resolved``: ``job_id,
    recording_id, title, artist, album``.  Of several answers to one job the smallest
    recording id counts.
    """
    r = one_per_key(resolved, ["job_id"], ["recording_id"]).select("job_id", "recording_id", *[
        X.nonempty(c).alias(f"_{c}") for c in ("title", "artist", "album")])
    return (uploads.join(r, "job_id", "left")
            .withColumn("title", F.coalesce("_title", F.concat(
                F.lit(FALLBACK_UPLOAD_TITLE), F.substring("job_id", 1, 8))))
            .withColumn("artist", F.coalesce("_artist", F.lit("Unknown")))
            .withColumn("album", F.col("_album"))
            .withColumn("metadata_status", F.lit("uploaded"))
            .drop("_title", "_artist", "_album"))


def choose_candidate(candidates: DataFrame) -> DataFrame:
    """Per request the first candidate whose names match, else the first with a preview.

    ``candidates``: ``request_id, pos, title, artist, preview, want_title,
    want_artist, cand_title, cand_artist``.
    """
    t, a, wt, wa = (F.lower(F.coalesce(c, F.lit(""))) for c in (
        "cand_title", "cand_artist", "want_title", "want_artist"))
    named = t.contains(wt) & (a.contains(wa) | wa.contains(a))
    playable = F.coalesce(X.nonempty("preview"), F.lit("")) != ""
    tier = F.when(F.coalesce(named, F.lit(False)), 0).when(playable, 1)
    ranked = candidates.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    best = ranked.groupBy("request_id").agg(
        F.min_by(F.struct(*candidates.columns, "_tier"), F.struct("_tier", "pos")).alias("b"))
    return best.select("b.*").withColumnRenamed("_tier", "tier")
