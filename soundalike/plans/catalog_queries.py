"""Registered queries of sources, listing, validation, catalogue jobs and evaluation (A, B, E-H, J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from soundalike.functions import text as X
from soundalike.functions.vectors import valid_vector
from soundalike.operators import catalog as K
from soundalike.operators import evaluate as E
from soundalike.operators import expand as EX
from soundalike.operators import feedback as FB
from soundalike.operators import identify as ID
from soundalike.operators import jobs as JB
from soundalike.operators import listing as LS
from soundalike.operators import rules as RU
from soundalike.operators import stats as ST
from soundalike.plans.function_queries import (
    CLEAN_ARTIST_SQL, CLEAN_TITLE_SQL, MATCH_SQL, NOISY_CTE, STATS_CTE, VIDEO_SUFFIX_SQL, _noisy,
    digest, digest_sql)
from soundalike.plans.registry import query
from soundalike.plans.retrieval_queries import WEIGHTS_CTE
from soundalike.session import scratch_path
from soundalike.sources import readers as RD
from soundalike.sources import sinks as SK
from soundalike.sources import views as V

GENRE_SQL = V._GENRE_SQL


def longs(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


# ------------------------------------------------------------------- sources (A)

def _feature_lines(songs):
    """Feature file lines: some malformed, some with vectors of a wrong length."""
    n = F.col("id")
    line = F.to_json(F.struct(
        (n + 5000).cast("string").alias("_tid"), "title", "artist", "album", "duration_sec", "bpm",
        "musical_key",
        F.to_json(F.when(n % 31 == 0, F.slice("learned", 1, 60)).otherwise(F.col("learned"))).alias(
            "learned_embedding"),
        F.to_json("handcrafted_raw").alias("handcrafted_raw"), F.lit("fma").alias("source"),
        F.lit("real").alias("embedding_type"), "metadata_status", "genre"))
    return songs.select(F.when(n % 29 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))


def _read_feature_file(spark, sf):
    path = scratch_path(spark, "features")
    _feature_lines(V.songs(spark, sf)).write.text(path)
    return RD.read_features_jsonl(spark, path, learned_dim=64)


@query("a1_feature_jsonl", f"""
SELECT id + 5000 AS deezer_id, title, bpm, genre, {digest_sql('learned')} AS learned
FROM songs WHERE id % 29 <> 0 AND id % 31 <> 0""")
def a1(spark, sf):
    good, _ = _read_feature_file(spark, sf)
    return good.select("deezer_id", "title", "bpm", "genre", digest("learned").alias("learned"))


@query("a13_feature_quarantine", """
SELECT CASE WHEN id % 29 = 0 THEN 'malformed' ELSE 'learned_dim' END AS reason, count(*) AS n
FROM songs WHERE id % 29 = 0 OR id % 31 = 0 GROUP BY ALL""")
def a13(spark, sf):
    _, bad = _read_feature_file(spark, sf)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def _tracks(spark, sf):
    path = scratch_path(spark, "raw_tracks")
    (V.raw_tracks(spark, sf).write.option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))
    return RD.read_fma_tracks(spark, path)


def _genres(spark, sf):
    path = scratch_path(spark, "genres")
    V.genre_table(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return RD.read_fma_genres(spark, path)


def _track_meta(spark, sf):
    return K.track_metadata(_tracks(spark, sf), K.genre_parents(_genres(spark, sf)))


@query("a2_track_csv", """
SELECT track_id, track_title, artist_name, album_title, duration_sec, release_year FROM track_meta""")
def a2(spark, sf):
    return longs(K.track_metadata(_tracks(spark, sf)).select(
        "track_id", "track_title", "artist_name", "album_title", "duration_sec", "release_year"),
        "release_year")


@query("a3_track_defaults", """
SELECT track_id, CASE WHEN track_title = '' THEN 'Track ' || track_id ELSE track_title END AS title,
  CASE WHEN artist_name = '' THEN 'Unknown' ELSE artist_name END AS artist,
  nullif(album_title, '') AS album, duration_sec FROM track_meta""")
def a3(spark, sf):
    return K.metadata_defaults(_tracks(spark, sf))


@query("a4_genre_csv", f"""
SELECT p_partkey AS genre_id, {GENRE_SQL.format(k='p_partkey')} AS title, p_partkey // 8 AS top_level
FROM part""")
def a4(spark, sf):
    return longs(_genres(spark, sf), "genre_id", "top_level")


@query("a5_subset_csv", """
SELECT p_partkey AS track_id, p_type AS genre_top FROM part
WHERE p_partkey % 3 = 1 AND p_partkey % 7 <> 0""")
def a5(spark, sf):
    """A file with two header rows (group, field), made from the part table."""
    path = scratch_path(spark, "tracks")
    n = F.col("p_partkey")
    body = V.table(spark, sf, "part").select(
        n.cast("string").alias("a"), F.when(n % 3 == 1, "small").otherwise("large").alias("b"),
        F.when(n % 7 == 0, "").otherwise(F.col("p_type")).alias("c"))
    head = spark.createDataFrame([("", "set", "track"), ("", "subset", "genre_top"),
                                  ("track_id", "", "")], "a string, b string, c string")
    head.coalesce(1).write.option("emptyValue", "").csv(path + "/part=0")
    body.write.option("emptyValue", "").csv(path + "/part=1")
    return RD.read_fma_subset(spark, path)


def _written(lines, name):
    """Lines written as one text table, for the file readers."""
    path = scratch_path(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


@query("a6_tag_tsv", """
SELECT track_id, path, tag_duration::DOUBLE AS tag_duration, array_to_string(tags, ',') AS tags
FROM tag_rows""")
def a6(spark, sf):
    return RD.read_jamendo_tags(spark, _written(V.tag_lines(spark, sf), "tags")).select(
        "track_id", "path", "tag_duration", F.array_join("tags", ",").alias("tags"))


@query("a7_meta_tsv", "SELECT * FROM meta_rows")
def a7(spark, sf):
    return longs(RD.read_jamendo_meta(spark, _written(V.meta_lines(spark, sf), "meta")), "release_year")


TRACK_LIST_SQL = """
SELECT p_partkey AS deezer_id, p_name AS title, p_brand AS artist, p_size::DOUBLE AS duration,
  CASE WHEN p_partkey % 4 <> 0 THEN 'http://p/' || p_partkey END AS preview_url FROM part"""


def _track_list(spark, sf):
    n = F.col("p_partkey")
    row = F.struct(
        n.alias("deezer_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.col("p_size").cast("double").alias("duration"),
        F.when(n % 4 != 0, F.concat(F.lit("http://p/"), n.cast("string"))).alias("preview_url"))
    return V.table(spark, sf, "part").select(n.alias("n"), row.alias("row"))


def _read_track_list(spark, path, lines):
    return RD.read_track_list(spark, path, lines=lines).select(
        "deezer_id", "title", "artist", "duration", "preview_url")


@query("a8_track_list_json", TRACK_LIST_SQL)
def a8(spark, sf):
    path = scratch_path(spark, "track_list")
    _track_list(spark, sf).select(F.to_json(F.array("row")).alias("value")).write.text(path)
    return _read_track_list(spark, path, lines=True)


@query("a8_track_array_json", TRACK_LIST_SQL)
def a8_array(spark, sf):
    """Files that are one array each, a track per line."""
    path = scratch_path(spark, "track_arrays")
    w = Window.partitionBy("shelf").orderBy("n")
    tracks = _track_list(spark, sf).withColumn("shelf", F.col("n") % 8)
    comma = F.when(F.row_number().over(w) == 1, "[").otherwise(",")
    end = F.when(F.lead("n").over(w).isNull(), "]").otherwise("")
    tracks.select("shelf", F.concat(comma, F.to_json("row"), end).alias("value")).write.partitionBy("shelf").text(path)
    return _read_track_list(spark, path, lines=False)


def _audio_files(spark, sf):
    n = F.col("doc_id")
    stem = F.when(n % 11 == 0, F.concat(F.lit("cover"), n.cast("string"))).otherwise(
        F.lpad(n.cast("string"), 6, "0"))
    return V.table(spark, sf, "documents").select(
        F.concat(F.lit("file:/audio/"), F.substring(F.lpad(n.cast("string"), 6, "0"), 1, 3),
                 F.lit("/"), stem, F.lit(".mp3")).alias("path"),
        F.col("n_chars").alias("length"))


@query("a9_audio_inventory", """
SELECT doc_id AS track_id, n_chars AS length,
  substr(lpad(doc_id::VARCHAR, 6, '0'), 1, 3) || '/' || lpad(doc_id::VARCHAR, 6, '0') || '.mp3'
    AS expected FROM documents WHERE doc_id % 11 <> 0""")
def a9(spark, sf):
    found = RD.audio_inventory(_audio_files(spark, sf))
    return found.select("track_id", "length",
                        RD.conventional_path(F.col("track_id")).alias("expected"))


@query("a9_audio_match", """
SELECT track_id, CASE WHEN doc_id % 3 = 0 THEN path WHEN doc_id % 3 = 1
  THEN replace(path, '.mp3', '.low.mp3') END AS audio_path FROM tag_rows""")
def a9_match(spark, sf):
    n = F.col("doc_id")
    files = V.table(spark, sf, "documents").where(n % 3 < 2).select(F.concat(
        F.lit("14/"), n.cast("string"), F.when(n % 3 == 1, ".low").otherwise(""),
        F.lit(".mp3")).alias("rel_path"))
    tracks = RD.jamendo_tags(V.tag_lines(spark, sf))
    return RD.match_audio(tracks, files).select("track_id", "audio_path")


@query("a11_feature_sink", f"""
SELECT id + 9000 AS deezer_id, title, {digest_sql('learned')} AS learned,
  {digest_sql('handcrafted_raw')} AS raw FROM songs""")
def a11(spark, sf):
    path = scratch_path(spark, "sink")
    rows = V.songs(spark, sf).select((F.col("id") + 9000).cast("string").alias("_tid"), "title",
                                     "learned", "handcrafted_raw")
    SK.write_features(rows.where("id % 2 = 0"), path)
    SK.write_features(rows.where("id % 2 = 1"), path)
    good, _ = RD.read_features_jsonl(spark, path, learned_dim=64)
    return good.select("deezer_id", "title", digest("learned").alias("learned"),
                       digest("handcrafted_raw").alias("raw"))


@query("a12_stats_versions", "WITH " + STATS_CTE + """
SELECT i, round(m, 6) AS mean, round(s, 6) AS std FROM st""")
def a12(spark, sf):
    songs = V.vectors(spark, sf)
    path = scratch_path(spark, "stats")
    SK.write_stats(ST.fit_stats(songs, "handcrafted_norm"), path)  # an older version
    SK.write_stats(ST.fit_stats(songs), path)
    latest = SK.latest_stats(spark.read.parquet(path))
    e = latest.select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "e"))
    return e.select((F.col("i") + 1).cast("long").alias("i"), F.round("e.mean", 6).alias("mean"),
                    F.round("e.std", 6).alias("std"))


def _incoming(spark, sf):
    n = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        n.alias("seq"), F.when(n % 11 != 0, F.expr("p_partkey div 2") + 1300).alias("deezer_id"),
        F.when(n % 43 != 0, F.col("p_name")).alias("title"),
        F.when(n % 47 == 0, F.repeat("p_brand", 80)).otherwise(F.col("p_brand")).alias("artist"),
        F.when(n % 2 == 0, "fma").alias("source"))


INCOMING_CTE = """incoming AS (
  SELECT p_partkey AS seq, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey // 2 + 1300 END AS deezer_id,
    CASE WHEN p_partkey % 43 <> 0 THEN p_name END AS title,
    CASE WHEN p_partkey % 47 = 0 THEN repeat(p_brand, 80) ELSE p_brand END AS artist,
    CASE WHEN p_partkey % 2 = 0 THEN 'fma' END AS source FROM part),
valid AS (SELECT * FROM incoming WHERE title IS NOT NULL AND length(title) <= 500
  AND length(artist) <= 500),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deezer_id ORDER BY seq) AS n
    FROM valid) WHERE deezer_id IS NULL OR (n = 1 AND deezer_id NOT IN (
      SELECT deezer_id FROM songs WHERE deezer_id IS NOT NULL)))"""


@query("j2_import_new", "WITH " + INCOMING_CTE + """
SELECT seq, deezer_id, title, coalesce(source, 'unknown') AS source, 'complete' AS metadata_status
FROM fresh""")
def j2(spark, sf):
    good, _ = RU.validate(_incoming(spark, sf), RU.song_rules())
    return K.import_new(V.vectors(spark, sf), good).select(
        "seq", "deezer_id", "title", "source", "metadata_status")


@query("a10_append", "WITH " + INCOMING_CTE + """
SELECT id, deezer_id, title FROM songs
UNION ALL SELECT NULL, deezer_id, title FROM fresh""")
def a10_append(spark, sf):
    """An import appended to the stored catalogue, which is then read back."""
    path = scratch_path(spark, "catalogue")
    songs = V.vectors(spark, sf)
    SK.append_songs(V.songs(spark, sf).select("id", "deezer_id", "title"), path)
    good, _ = RU.validate(_incoming(spark, sf), RU.song_rules())
    new = K.import_new(songs, good).select(F.lit(None).cast("long").alias("id"), "deezer_id", "title")
    SK.append_songs(new, path)
    return spark.read.parquet(path)


@query("a10_import_report", "WITH " + INCOMING_CTE + """
SELECT (SELECT count(*) FROM incoming) AS attempted,
  (SELECT count(*) FROM incoming) - (SELECT count(*) FROM valid) AS rejected,
  (SELECT count(*) FROM fresh) AS inserted,
  (SELECT count(*) FROM valid) - (SELECT count(*) FROM fresh) AS skipped""")
def a10(spark, sf):
    return K.import_report(V.vectors(spark, sf), _incoming(spark, sf))


# -------------------------------------------------------- listing and filters (B, G)

@query("b1_search", """
SELECT id, title, artist FROM songs
WHERE (contains(lower(title), 'red') OR contains(lower(artist), 'red'))
ORDER BY created_at DESC, id LIMIT 20""")
def b1(spark, sf):
    return LS.search(V.songs(spark, sf), "RED").select("id", "title", "artist")


@query("g5_search_page", """
SELECT id, title, genre FROM songs
WHERE contains(lower(artist), 'brand#1') AND genre = 'g3'
ORDER BY created_at DESC, id LIMIT 10 OFFSET 5""")
def g5(spark, sf):
    return LS.search(V.songs(spark, sf), "Brand#1", "g3", 10, 5).select("id", "title", "genre")


@query("b2_by_id", "SELECT id, title, artist, bpm FROM songs WHERE id = 42")
def b2(spark, sf):
    return LS.by_id(V.songs(spark, sf), 42).select("id", "title", "artist", "bpm")


@query("b3_by_ids", """
SELECT id, title FROM songs WHERE id IN (SELECT query_song_id FROM feedback)""")
def b3(spark, sf):
    ids = V.feedback(spark, sf).select(F.col("query_song_id").alias("id"))
    return LS.by_ids(V.songs(spark, sf), ids).select("id", "title")


@query("b4_count", "SELECT count(*) AS count FROM embeddings")
def b4(spark, sf):
    return LS.count_songs(V.table(spark, sf, "embeddings"))


@query("b5_genres", "SELECT DISTINCT genre FROM songs WHERE genre IS NOT NULL")
def b5(spark, sf):
    return LS.genres(V.vectors(spark, sf))


@query("b6_bpm_range", "SELECT id, bpm FROM songs WHERE bpm BETWEEN 0 AND 999")
def b6(spark, sf):
    return V.vectors(spark, sf).where(F.col("bpm").between(0, 999)).select("id", "bpm")


@query("b7_exclusions", """
SELECT id FROM songs WHERE id IS DISTINCT FROM 7
  AND id NOT IN (SELECT result_song_id FROM feedback WHERE rating = -1)""")
def b7(spark, sf):
    bad = V.feedback(spark, sf).where("rating = -1").select(F.col("result_song_id").alias("id"))
    songs = V.vectors(spark, sf).where(~F.col("id").eqNullSafe(7))
    return K.pending(songs, bad, "id").select("id")


@query("b9_not_failed", "SELECT id FROM songs WHERE metadata_status <> 'failed'")
def b9(spark, sf):
    return LS.not_failed(V.vectors(spark, sf)).select("id")


@query("b10_literal_contains", """
SELECT doc_id, contains(lower(text), '%') AS percent, contains(lower(text), 'th_e') AS underscore,
  contains(lower(text), 'the ') AS word FROM documents""")
def b10(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", LS.contains_ignoring_case("text", "%").alias("percent"),
        LS.contains_ignoring_case("text", "TH_E").alias("underscore"),
        LS.contains_ignoring_case("text", "The ").alias("word"))


def _reasons(df, rules, *keys):
    return RU.with_reasons(df, rules).select(*keys, F.array_join("reasons", ",").alias("reasons"))


def reasons_sql(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + ") AS reasons"


@query("b11_song_rules", "SELECT doc_id, " + reasons_sql(
    ("title_missing", "doc_id % 23 = 0"), ("artist_missing", "doc_id % 29 = 0"),
    ("title_too_long", "doc_id % 23 <> 0 AND length(text) > 500"),
    ("artist_too_long", "false")) + " FROM documents")
def b11(spark, sf):
    n = F.col("doc_id")
    d = V.table(spark, sf, "documents").select(
        n, F.when(n % 23 != 0, F.col("text")).alias("title"),
        F.when(n % 29 != 0, F.col("source")).alias("artist"))
    return _reasons(d, RU.song_rules(), "doc_id")


@query("b11_oversized_batches", """
SELECT o_orderpriority AS batch_id, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 500""")
def b11_batches(spark, sf):
    return RU.oversized_batches(V.table(spark, sf, "orders").withColumnRenamed(
        "o_orderpriority", "batch_id"))


@query("b12_feedback_rules", "SELECT event_id, " + reasons_sql(
    ("query_missing", "user_id % 31 = 0"), ("result_missing", "event_id % 37 = 0"),
    ("bad_rating", "event_type IN ('signup', 'view')"),
    ("bad_reason_tag", "event_id % 5 = 4")) + " FROM events")
def b12(spark, sf):
    n, u = F.col("event_id"), F.col("user_id")
    tag = (F.when(n % 5 == 0, "wrong_genre").when(n % 5 == 1, "other").when(n % 5 == 4, "rude"))
    e = V.table(spark, sf, "events").select(
        n, F.when(u % 31 != 0, u).alias("query_song_id"), F.when(n % 37 != 0, n).alias(
            "result_song_id"),
        F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", -1)
        .when(F.col("event_type") != "view", 1).alias("rating"), tag.alias("reason_tag"))
    return _reasons(e, RU.feedback_rules(), "event_id")


@query("b13_click_rules", "SELECT id, " + reasons_sql(
    ("session_too_long", "false"), ("bad_action", "action = 'signup'"),
    ("bad_rank", "result_rank NOT BETWEEN 1 AND 200")) + " FROM clicks")
def b13(spark, sf):
    return _reasons(V.clicks(spark, sf), RU.click_rules(), "id")


@query("b14_job_rules", "SELECT o_orderkey, " + reasons_sql(
    ("bad_status", "o_orderstatus = 'P' AND o_orderkey % 2 = 0"),
    ("bad_progress", "o_totalprice > 250000"), ("bad_attempts", "o_orderkey % 9 = 0"))
    + " FROM orders")
def b14(spark, sf):
    n = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", "completed")
              .when(F.col("o_orderstatus") == "O", "processing")
              .when(n % 2 == 0, "paused").otherwise("queued"))
    o = V.table(spark, sf, "orders").select(
        n, status.alias("status"), (F.col("o_totalprice") / 250000).alias("progress"),
        F.when(n % 9 == 0, -1).otherwise(1).alias("attempt_count"))
    return _reasons(o, RU.job_rules(), "o_orderkey")


@query("b15_audio_rules", "SELECT doc_id, " + reasons_sql(
    ("too_large", "n_chars * 20000 > 52428800"), ("bad_type", "doc_id % 4 = 1 OR doc_id % 4 = 3"),
    ("no_audio_stream", "doc_id % 17 = 0"), ("no_duration", "doc_id % 19 = 0"),
    ("too_long", "doc_id % 19 <> 0 AND n_chars / 3.0 > 900")) + " FROM documents")
def b15(spark, sf):
    n, c = F.col("doc_id"), F.col("n_chars")
    octet = "application/octet-stream"
    d = V.table(spark, sf, "documents").select(
        n, F.when(n % 4 == 0, "audio/flac").when(n % 4 == 3, "text/html").otherwise(octet).alias(
            "mime"),
        F.when(n % 4 == 2, "ID3abc").otherwise("RIFF").alias("header"), (c * 20000).alias("size"),
        F.when(n % 17 == 0, 0).otherwise(1).alias("n_streams"),
        F.when(n % 19 != 0, c / 3.0).alias("duration_sec"))
    return _reasons(d, RU.audio_rules(), "doc_id")


ALLOWED = [f"Child's play {k}" if k % 5 == 0 else f"Genre {k}" for k in range(0, 60)]
EXCLUDED = ["Genre 9", "Genre 12", "Child's play 30", "Genre 21"]


def quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


@query("b16_track_selection", f"""
SELECT track_id, genre, sub_genre, release_year FROM track_meta
WHERE (genre IN ({quoted(ALLOWED)}) OR sub_genre IN ({quoted(ALLOWED)}))
  AND sub_genre NOT IN ({quoted(EXCLUDED)}) AND release_year >= 2000""")
def b16(spark, sf):
    meta = _track_meta(spark, sf)
    return longs(LS.select_tracks(meta, ALLOWED, EXCLUDED, 2000).select(
        "track_id", "genre", "sub_genre", "release_year"), "release_year")


TAG_OUTCOME = """CASE WHEN NOT list_has_any(tags, ['techno','house','ambient','idm','club','edm'])
  THEN 'no_tag' WHEN coalesce(release_year, 9999) < 2005 THEN 'too_old' ELSE 'kept' END"""


@query("b17_tag_selection", f"""
SELECT {TAG_OUTCOME} AS outcome, count(*) AS count
FROM tag_rows LEFT JOIN meta_rows USING (track_id) GROUP BY ALL""")
def b17(spark, sf):
    tags = RD.jamendo_tags(V.tag_lines(spark, sf))
    meta = RD.jamendo_meta(V.meta_lines(spark, sf))
    return ST.outcome_counts(LS.tag_selection(tags, meta, 2005))


@query("b18_vector_backlog", """
SELECT id, deezer_id FROM songs WHERE mert IS NULL AND deezer_id IS NOT NULL""")
def b18(spark, sf):
    return LS.vector_backlog(V.songs(spark, sf)).select("id", "deezer_id")


@query("b19_genre_backlog", """
SELECT id, deezer_id FROM songs WHERE genre = 'g3' AND deezer_id IS NOT NULL""")
def b19(spark, sf):
    return LS.genre_backlog(V.songs(spark, sf), "g3").select("id", "deezer_id")


@query("b20_valid_vectors", "SELECT id FROM songs WHERE len(learned) = 64 AND id % 3 <> 0")
def b20(spark, sf):
    v = F.when(F.col("id") % 3 == 0, F.slice("learned", 1, 10)).otherwise(F.col("learned"))
    return V.vectors(spark, sf).where(valid_vector(v, 64)).select("id")


@query("b21_artist_gate", """
SELECT s_suppkey AS artist_id FROM supplier
WHERE s_suppkey IN (SELECT artist_id FROM graph WHERE pos = 1 AND coalesce(electronic, false))""")
def b21(spark, sf):
    g = V.artist_graph(spark, sf)
    return LS.electronic_artists(g["artists"], g["tracks"], g["albums"])


def _mapping_lines(spark, sf):
    """Lines of two files that map names to external ids, with repeats and blanks."""
    n = F.col("l_partkey")
    return V.table(spark, sf, "lineitem").join(
        V.table(spark, sf, "part"), n == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        (F.lit(90000) + n).alias("deezer_id"),
        F.when(n % 10 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.when(
            n % 3 == 0, " (Extended Mix)").when(n % 3 == 1, " - Radio Edit").otherwise(""))
        ).alias("title"), F.col("p_brand").alias("artist"))


MAPPING_CTE = """lines AS (
  SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS line, 90000 + l_partkey AS deezer_id,
    trim(p_name || CASE l_partkey % 3 WHEN 0 THEN ' (Extended Mix)' WHEN 1 THEN ' - Radio Edit'
      ELSE '' END) AS title, p_brand AS artist
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 10 <> 0),
mapping AS (SELECT deezer_id, title, artist, min((file, line)) AS fl FROM lines GROUP BY ALL)"""


@query("g3_first_per_id", "WITH " + MAPPING_CTE + """
SELECT deezer_id, title, artist, struct_extract(fl, 1) AS file, struct_extract(fl, 2) AS line
FROM mapping""")
def g3(spark, sf):
    return K.external_id_mapping(_mapping_lines(spark, sf)).select(
        "deezer_id", "title", "artist", "file", "line")


# --------------------------------------------------------------- aggregates (E)

@query("e1_fit_stats", "WITH " + STATS_CTE + """
SELECT i, round(m, 6) AS mean, round(s, 6) AS std, n FROM st""")
def e1(spark, sf):
    s = ST.fit_stats(V.vectors(spark, sf))
    e = s.select("n_songs", F.posexplode(F.arrays_zip("mean", "std")).alias("i", "e"))
    return e.select((F.col("i") + 1).cast("long").alias("i"), F.round("e.mean", 6).alias("mean"),
                    F.round("e.std", 6).alias("std"), F.col("n_songs").alias("n"))


STATS_SQL = """SELECT query_song_id, result_song_id, count(*) FILTER (rating = 1) AS total_up,
  count(*) FILTER (rating = -1) AS total_down,
  count(*) FILTER (rating = 1) - count(*) FILTER (rating = -1) AS net_score,
  count(*) AS total_votes FROM feedback GROUP BY ALL"""


@query("e2_feedback_stats", STATS_SQL)
def e2(spark, sf):
    return FB.feedback_stats(V.feedback(spark, sf))


@query("e3_top_pairs", f"""
(SELECT *, 'top' AS kind FROM ({STATS_SQL})
 ORDER BY net_score DESC, query_song_id, result_song_id LIMIT 20)
UNION ALL
(SELECT *, 'flop' AS kind FROM ({STATS_SQL})
 ORDER BY net_score, query_song_id, result_song_id LIMIT 20)""")
def e3(spark, sf):
    stats = FB.feedback_stats(V.feedback(spark, sf))
    return FB.top_pairs(stats, "top").withColumn("kind", F.lit("top")).unionByName(
        FB.top_pairs(stats, "flop").withColumn("kind", F.lit("flop")))


@query("e4_genre_focus_weights", "WITH " + WEIGHTS_CTE + " SELECT * FROM weights")
def e4(spark, sf):
    return FB.genre_focus_weights(V.feedback(spark, sf), V.vectors(spark, sf))


@query("e5_list_weights", "WITH " + WEIGHTS_CTE + " SELECT * FROM weights WHERE genre = 'g1'")
def e5(spark, sf):
    w = FB.genre_focus_weights(V.feedback(spark, sf), V.vectors(spark, sf))
    return FB.list_weights(w, "g1")


@query("e6_ab_summary", """
SELECT ab_group, action, count(*) AS event_count, count(DISTINCT session_hash) AS unique_sessions,
  min(created_at)::DATE::VARCHAR AS first_event, max(created_at)::DATE::VARCHAR AS last_event
FROM clicks GROUP BY ALL""")
def e6(spark, sf):
    out = FB.ab_summary(V.clicks(spark, sf))
    return out.withColumn("first_event", F.col("first_event").cast("string")).withColumn(
        "last_event", F.col("last_event").cast("string"))


HITS_SQL = """rows AS (SELECT * FROM songs WHERE genre IS NOT NULL),
sims AS (SELECT a.id AS q, a.genre AS own, b.id, b.genre,
    list_cosine_similarity(a.learned, b.learned) AS l,
    list_cosine_similarity(a.handcrafted_norm, b.handcrafted_norm) AS h
  FROM rows a CROSS JOIN rows b WHERE a.id <> b.id),
long AS (SELECT 'learned' AS signal, q, own, id, genre, round(l, 12) AS s FROM sims
  UNION ALL SELECT 'handcrafted', q, own, id, genre, round(h, 12) FROM sims
  UNION ALL SELECT 'fused', q, own, id, genre, round(0.8 * l + 0.2 * h, 12) FROM sims),
hits AS (SELECT signal, q, own, count(*) FILTER (genre = own) / 10 AS p
  FROM (SELECT * FROM long
        QUALIFY row_number() OVER (PARTITION BY signal, q ORDER BY s DESC, id) <= 10) GROUP BY ALL)"""


@query("e7_precision_at_10", "WITH " + HITS_SQL + """
SELECT signal, round(avg(p), 6) AS precision, count(*) AS count FROM hits GROUP BY ALL""")
def e7(spark, sf):
    return E.precision_of_signals(V.vectors(spark, sf)).withColumn("precision", F.round("precision", 6))


@query("e8_precision_by_genre", "WITH " + HITS_SQL + """
SELECT own AS genre, round(avg(p), 6) AS precision, count(*) AS count FROM hits
WHERE signal = 'fused' GROUP BY ALL HAVING count(*) >= 2""")
def e8(spark, sf):
    return E.precision_at_k(V.vectors(spark, sf), "fused", by="genre").withColumn(
        "precision", F.round("precision", 6))


@query("e9_baseline_verdict", """
WITH g AS (SELECT count(DISTINCT genre) AS n FROM songs)
SELECT round(1 / n, 6) AS baseline, CASE WHEN 1 / n > 0.5 THEN 'go' ELSE 'review' END AS verdict
FROM g""")
def e9(spark, sf):
    base = E.random_baseline(V.vectors(spark, sf))
    out = E.verdict(base.withColumnRenamed("baseline", "precision"))
    return out.select(F.round("precision", 6).alias("baseline"), "verdict")


@query("e9_fused_verdict", "WITH " + HITS_SQL + """
SELECT round(avg(p), 6) AS precision, CASE WHEN avg(p) > 0.5 THEN 'go' ELSE 'review' END AS verdict
FROM hits WHERE signal = 'fused'""")
def e9_fused(spark, sf):
    out = E.verdict(E.precision_at_k(V.vectors(spark, sf), "fused"))
    return out.select(F.round("precision", 6).alias("precision"), "verdict")


def _fma_catalog(spark, sf):
    """Songs of the catalogue that once came from the raw track table."""
    n = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        n.alias("id"), F.when(n % 13 == 0, F.concat(F.lit("FMA Track "), n.cast("string")))
        .when(n % 7 == 0, F.concat(F.lit("lost "), n.cast("string")))
        .otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"),
        F.lit(None).cast("string").alias("genre"), F.lit(None).cast("int").alias("release_year"))


def _classified(spark, sf):
    meta = _track_meta(spark, sf).withColumn("row_no", F.col("track_id"))
    return K.classify(_fma_catalog(spark, sf), meta, ALLOWED, EXCLUDED, 2000)


CLASSIFIED_CTE = f"""fma AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'FMA Track ' || p_partkey
    WHEN p_partkey % 7 = 0 THEN 'lost ' || p_partkey ELSE p_name END AS title, p_brand AS artist
  FROM part),
m AS (SELECT track_id, genre, sub_genre, release_year,
    CASE WHEN track_title = '' THEN 'FMA Track ' || track_id ELSE track_title END AS title
  FROM track_meta),
by_title AS (SELECT title, min(track_id) AS t FROM m GROUP BY ALL),
linked AS (SELECT f.*, coalesce(i.track_id, b.t) AS track_id FROM fma f
  LEFT JOIN m i ON f.title = 'FMA Track ' || i.track_id LEFT JOIN by_title b ON b.title = f.title),
classified AS (SELECT l.id, l.track_id, m.genre AS new_genre, m.release_year AS new_year,
    CASE WHEN l.track_id IS NULL THEN 'unmatched'
      WHEN coalesce(m.genre IN ({quoted(ALLOWED)}), false)
        AND NOT coalesce(m.sub_genre IN ({quoted(EXCLUDED)}), false) AND m.release_year >= 2000
      THEN 'keep' ELSE 'delete' END AS verdict
  FROM linked l LEFT JOIN m USING (track_id))"""


@query("f10_j7_classify", "WITH " + CLASSIFIED_CTE + """
SELECT id, track_id, new_genre, new_year, verdict FROM classified""")
def j7(spark, sf):
    return longs(_classified(spark, sf).select(
        "id", "track_id", "new_genre", "new_year", "verdict"), "new_year")


@query("j7_cleanup", "WITH " + CLASSIFIED_CTE + """
SELECT id, new_genre AS genre, new_year AS release_year FROM classified WHERE verdict = 'keep'""")
def j7_cleanup(spark, sf):
    return longs(K.cleanup(_classified(spark, sf)).select("id", "genre", "release_year"),
                 "release_year")


@query("e10_deletions_by_genre", "WITH " + CLASSIFIED_CTE + """
SELECT coalesce(new_genre, 'Unknown') AS genre, count(*) AS count FROM classified
WHERE verdict = 'delete' GROUP BY ALL""")
def e10(spark, sf):
    return K.deletions_by_genre(_classified(spark, sf))


@query("e11_coverage", """
SELECT count(*) AS rows, count(genre) AS genre, count(bpm) AS bpm, count(mert) AS mert,
  count(deezer_id) AS deezer_id FROM songs""")
def e11(spark, sf):
    return ST.coverage(V.vectors(spark, sf), ("genre", "bpm", "mert", "deezer_id"))


def _vector_results(songs):
    n = F.col("id")
    return songs.where(n % 7 != 0).select(
        "id", F.when((n % 5 != 0) & (n % 3 != 0), F.col("learned")).alias("vector"),
        F.when(n % 3 == 0, "no_preview").alias("error"))


@query("e12_outcomes", """
SELECT CASE WHEN id % 11 = 0 THEN 'skipped' WHEN id % 7 <> 0 AND id % 3 = 0 THEN 'no_preview'
  WHEN id % 7 = 0 OR id % 5 = 0 THEN 'failed' ELSE 'extracted' END AS outcome, count(*) AS count
FROM songs WHERE mert IS NULL AND deezer_id IS NOT NULL GROUP BY ALL""")
def e12(spark, sf):
    songs = V.songs(spark, sf)
    done = songs.where("id % 11 = 0").select("id")
    return ST.outcome_counts(K.vector_outcomes(
        LS.vector_backlog(songs), _vector_results(songs), done))


PAIR_SQL = """dealt AS (SELECT id, r, md5(id || ':42:' || r) AS h
    FROM songs, (SELECT unnest(range(1, 11)) AS r) WHERE {where}),
met AS (SELECT id AS id_a, coalesce(lead(id) OVER w, first_value(id) OVER w) AS id_b FROM dealt
  WINDOW w AS (PARTITION BY r, ('0x' || substr(h, 1, 4))::BIGINT % 64 ORDER BY h, id)),
sims AS (SELECT id_a, id_b, list_cosine_similarity(a.learned, b.learned) AS s,
    list_cosine_similarity(a.mert, b.mert) AS t
  FROM met JOIN songs a ON a.id = id_a JOIN songs b ON b.id = id_b WHERE id_a <> id_b)"""


@query("e13_similarity_profile", "WITH " + PAIR_SQL.format(where="true") + """
SELECT count(*) AS pairs, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std,
  round(min(s), 6) AS min, round(max(s), 6) AS max, round(median(s), 6) AS median FROM sims""")
def e13(spark, sf):
    sims = E.pair_similarities(E.song_pairs(V.vectors(spark, sf)))
    p = E.similarity_profile(sims)
    return p.select("pairs", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("e14_percentiles", "WITH " + PAIR_SQL.format(where="true") + """
SELECT round(quantile_cont(s, 0.05), 6) AS p5, round(quantile_cont(s, 0.25), 6) AS p25,
  round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.95), 6) AS p95 FROM sims""")
def e14(spark, sf):
    sims = E.pair_similarities(E.song_pairs(V.vectors(spark, sf)))
    p = E.similarity_profile(sims)
    return p.select(*[F.round(c, 6).alias(c) for c in ("p5", "p25", "p75", "p95")])


@query("e14_percentiles_with_outlier", "WITH " + PAIR_SQL.format(where="true") + """,
w AS (SELECT s FROM sims UNION ALL SELECT 1e9)
SELECT round(quantile_cont(s, 0.05), 6) AS p5, round(quantile_cont(s, 0.5), 6) AS p50,
  round(quantile_cont(s, 0.95), 6) AS p95 FROM w""")
def e14_outlier(spark, sf):
    """One value far from all others leaves the work spread."""
    sims = E.pair_similarities(E.song_pairs(V.vectors(spark, sf))).select("sim_learned")
    far = spark.createDataFrame([(1e9,)], "sim_learned double")
    p = E.percentiles(sims.unionByName(far), "sim_learned", (0.05, 0.5, 0.95))
    return spark.createDataFrame([tuple(round(x, 6) for x in p)], "p5 double, p50 double, p95 double")


EDGES = (-0.3, -0.15, -0.05, 0.0, 0.02, 0.05, 0.15, 0.3)


@query("e15_histogram", "WITH " + PAIR_SQL.format(where="true") + f""",
b AS (SELECT i, {list(EDGES)}[i + 1] AS lower, {list(EDGES)}[i + 2] AS upper FROM range({len(EDGES) - 1}) r(i))
SELECT i AS bin, lower::DOUBLE AS lower, upper::DOUBLE AS upper, count(s) AS count,
  round(count(s) / (SELECT count(*) FROM sims), 6) AS share
FROM b LEFT JOIN sims ON s >= lower AND (s < upper OR (i = {len(EDGES) - 2} AND s = upper))
GROUP BY ALL""")
def e15(spark, sf):
    sims = E.pair_similarities(E.song_pairs(V.vectors(spark, sf)))
    out = E.histogram(sims, "sim_learned", EDGES)
    return longs(out.withColumn("share", F.round("share", 6)), "bin")


@query("e16_pca_profile")
def e16(spark, sf):
    return E.pca_profile(E.pca_ratios(V.vectors(spark, sf)))


@query("g8_axis_profile", """
WITH v AS (SELECT i, var_pop(v) AS v FROM (
    SELECT unnest(learned) AS v, unnest(range(len(learned))) AS i FROM songs) GROUP BY i),
r AS (SELECT row_number() OVER (ORDER BY v DESC, i) AS pc, v / (SELECT sum(v) FROM v) AS ratio FROM v),
c AS (SELECT *, sum(ratio) OVER (ORDER BY pc) AS cumulative FROM r)
SELECT round(max(cumulative) FILTER (pc = 1), 6) AS pc1, round(max(cumulative) FILTER (pc = 2), 6) AS pc1_2,
  min(pc) FILTER (cumulative >= 0.9) AS pcs_90, min(pc) FILTER (cumulative >= 0.95) AS pcs_95,
  round(exp(-sum(ratio * ln(ratio + 1e-10))), 6) AS effective_dim FROM c""")
def g8(spark, sf):
    """The profile of the vectors' own axes, which says what components add to it."""
    p = E.pca_profile(E.axis_ratios(V.vectors(spark, sf)))
    return p.select(*[F.round(c, 6).alias(c) for c in ("pc1", "pc1_2")], "pcs_90", "pcs_95",
                    F.round("effective_dim", 6).alias("effective_dim"))


@query("e17_variance_ratios")
def e17(spark, sf):
    return E.pca_ratios(V.vectors(spark, sf))


@query("e17_ratio_sums", """
WITH x AS (SELECT id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM (
    SELECT id, unnest(learned) AS v, unnest(range(len(learned))) AS i FROM songs)),
c AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS c FROM x a JOIN x b USING (id) GROUP BY ALL),
t AS (SELECT sum(c) FILTER (i = j) AS trace, sum(c * c) AS squares FROM c)
SELECT 1.0::DOUBLE AS total, round(squares / (trace * trace), 6) AS squares FROM t""")
def e17_sums(spark, sf):
    """Ratios of all components: they sum to one, their squares to the covariance's norm over its trace squared."""
    ratios = E.pca_ratios(V.vectors(spark, sf))
    return ratios.agg(F.round(F.sum("ratio"), 6).alias("total"),
                      F.round(F.sum(F.col("ratio") * F.col("ratio")), 6).alias("squares"))


@query("e18_silhouette")
def e18(spark, sf):
    return E.silhouette(V.vectors(spark, sf))


@query("e18_silhouette_of_points", """
WITH p AS (SELECT id, coalesce(genre, 'Unknown') AS label, learned[1] AS x, learned[2] AS y FROM songs),
d AS (SELECT a.id, a.label, b.label AS other, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS total,
    count(*) FILTER (a.id <> b.id) AS n FROM p a CROSS JOIN p b GROUP BY ALL),
v AS (SELECT id, label, max(total / greatest(n, 1)) FILTER (other = label) AS a,
    min(total / n) FILTER (other <> label) AS b, max(n) FILTER (other = label) AS own FROM d GROUP BY ALL)
SELECT count(*) AS rows, count(DISTINCT label) AS labels,
  round(avg(CASE WHEN own > 0 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette
FROM v""")
def e18_points(spark, sf):
    points = V.vectors(spark, sf).select("id", F.coalesce("genre", F.lit("Unknown")).alias("label"),
                                         F.col("learned")[0].alias("x"), F.col("learned")[1].alias("y"))
    return E.silhouette_of(points).select("rows", "labels", F.round("silhouette", 6).alias("silhouette"))


@query("e19_spearman", "WITH " + PAIR_SQL.format(where="mert IS NOT NULL") + """,
ranked AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rs,
    rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS rt FROM sims)
SELECT count(*) AS pairs, round(corr(rs, rt), 6) AS rho FROM ranked""")
def e19(spark, sf):
    both = V.vectors(spark, sf).where(F.col("mert").isNotNull())
    sims = E.pair_similarities(E.song_pairs(both, columns=("learned", "mert")), ("learned", "mert"))
    rho = E.spearman(sims, "sim_learned", "sim_mert")
    return sims.agg(F.count("*").alias("pairs"), F.round(F.lit(rho), 6).alias("rho"))


@query("e20_compare_spaces")
def e20(spark, sf):
    return E.compare_spaces(V.vectors(spark, sf), "mert", "learned")


@query("e20_agreement", "WITH " + PAIR_SQL.format(where="mert IS NOT NULL") + """,
ranked AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rs,
    rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS rt FROM sims),
n AS (SELECT count(*) AS pairs, corr(rs, rt) AS rho, stddev_pop(t) AS a, stddev_pop(s) AS b FROM ranked)
SELECT pairs, round(rho, 6) AS rho, round(a, 6) AS std_new, round(b, 6) AS std_old,
  CASE WHEN rho > 0.7 THEN 'strong' WHEN rho > 0.4 THEN 'moderate' ELSE 'weak' END AS agreement,
  a > b * 1.2 AS better_spread, rho < 0.5 AS complementary, a <= b * 0.8 AS worse_spread FROM n""")
def e20_agreement(spark, sf):
    out = E.compare_spaces(V.vectors(spark, sf), "mert", "learned")
    return out.select("pairs", *[F.round(c, 6).alias(c) for c in ("rho", "std_new", "std_old")],
                      "agreement", "better_spread", "complementary", "worse_spread")


@query("e22_sample", "SELECT id FROM songs ORDER BY md5(id || ':42'), id LIMIT 100")
def e22(spark, sf):
    return E.sample_songs(V.vectors(spark, sf), 100).select("id")


@query("e23_stratified_sample", """
SELECT id, genre FROM songs WHERE genre IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY genre ORDER BY md5(id || ':42'), id) <= 10""")
def e23(spark, sf):
    return E.stratified_sample(V.vectors(spark, sf), 10).select("id", "genre")


@query("e24_canary", """
SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.learned, b.learned), 6) AS similarity,
  list_cosine_similarity(a.learned, b.learned) > 0.1 AS healthy
FROM songs a JOIN songs b ON b.id = a.id + 1""")
def e24(spark, sf):
    songs = V.vectors(spark, sf)
    n = F.col("id")
    pairs = songs.select(n.alias("id_a"), (n + 1).alias("id_b")).join(
        songs.select(n.alias("id_b")), "id_b", "left_semi")
    return E.canary(pairs, songs, 0.1).withColumn("similarity", F.round("similarity", 6))


# --------------------------------------------------------- joins and sets (F, H)

@query("f2_votes_by_genre", """
SELECT genre, rating, count(*) AS n FROM feedback JOIN songs s ON s.id = query_song_id GROUP BY ALL""")
def f2(spark, sf):
    votes = V.feedback(spark, sf).groupBy("query_song_id", "rating").agg(F.count("*").alias("n"))
    genres = V.vectors(spark, sf).select(F.col("id").alias("query_song_id"), "genre")
    return longs(votes.join(genres, "query_song_id").groupBy("genre", "rating").agg(
        F.sum("n").alias("n")), "rating")


def _track_features(spark, sf):
    n = F.col("id")
    return V.songs(spark, sf).select(
        (n * 3).alias("track_id"), F.when(n % 4 != 0, F.col("duration_sec")).alias("duration"),
        "bpm", F.when(n % 6 != 0, F.col("musical_key")).alias("musical_key"), "learned",
        "handcrafted_raw")


FMA_SQL = """fma_songs AS (SELECT s.id * 3 AS track_id, 'fma' AS source,
    coalesce(nullif(track_title, ''), 'FMA Track ' || (s.id * 3)) AS title,
    coalesce(nullif(artist_name, ''), 'Unknown') AS artist, nullif(album_title, '') AS album,
    coalesce(CASE WHEN s.id % 4 <> 0 THEN s.duration_sec END, m.duration_sec) AS duration_sec,
    CASE WHEN s.id % 6 <> 0 THEN musical_key ELSE 'Unknown' END AS musical_key,
    CASE WHEN nullif(track_title, '') IS NULL THEN 'partial' ELSE 'complete' END AS metadata_status,
    m.genre, m.release_year
  FROM songs s LEFT JOIN track_meta m ON m.track_id = s.id * 3)"""
SHOWN = ("title", "artist", "album", "duration_sec", "musical_key", "metadata_status", "genre",
         "release_year", "source")


@query("f4_features_with_metadata", "WITH " + FMA_SQL + " SELECT * FROM fma_songs")
def f4(spark, sf):
    rows = K.fma_songs(_track_features(spark, sf), _track_meta(spark, sf))
    return longs(rows.select("track_id", *SHOWN), "release_year")


JAM_SQL = """jam_songs AS (SELECT 'track_' || s.id AS track_id, 'jamendo' AS source,
    coalesce(nullif(m.title, ''), 'Jamendo track_' || s.id) AS title,
    coalesce(nullif(m.artist, ''), 'Unknown') AS artist, nullif(m.album, '') AS album,
    coalesce(CASE WHEN s.id % 4 <> 0 THEN s.duration_sec END, nullif(t.tag_duration, 0)) AS duration_sec,
    CASE WHEN s.id % 6 <> 0 THEN musical_key ELSE 'Unknown' END AS musical_key,
    CASE WHEN nullif(m.title, '') IS NULL THEN 'partial' ELSE 'complete' END AS metadata_status,
    coalesce(t.genre, 'Electronic') AS genre, m.release_year
  FROM songs s LEFT JOIN meta_rows m ON m.track_id = 'track_' || s.id
  LEFT JOIN (SELECT *, list_filter(list_transform(tags, lambda x: CASE x WHEN 'techno' THEN 'Techno'
      WHEN 'house' THEN 'House' WHEN 'ambient' THEN 'Ambient' WHEN 'idm' THEN 'IDM'
      WHEN 'club' THEN 'Dance' WHEN 'edm' THEN 'Electronic' END), lambda g: g IS NOT NULL)[1] AS genre
    FROM tag_rows) t ON t.track_id = 'track_' || s.id)"""


def _jamendo(spark, sf):
    tags = RD.jamendo_tags(V.tag_lines(spark, sf)).withColumn(
        "genre", X.first_mapped_tag("tags", X.TAG_GENRES))
    meta = RD.jamendo_meta(V.meta_lines(spark, sf))
    feats = _track_features(spark, sf).withColumn(
        "track_id", F.concat(F.lit("track_"), (F.col("track_id") / 3).cast("long").cast("string")))
    return K.jamendo_songs(feats, meta, tags.select("track_id", "tag_duration", "genre"))


@query("i26_tagged_rows", "WITH " + JAM_SQL + " SELECT * FROM jam_songs")
def i26(spark, sf):
    return longs(_jamendo(spark, sf).select("track_id", *SHOWN), "release_year")


CRAWL_SQL = """crawl_songs AS (SELECT p_partkey AS deezer_id, 'deezer' AS source, p_name AS title,
    p_brand AS artist, nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END, '') AS album,
    coalesce(CASE WHEN s.id % 4 <> 0 THEN s.duration_sec END, p_size) AS duration_sec,
    CASE WHEN s.id % 6 <> 0 THEN musical_key ELSE 'Unknown' END AS musical_key,
    'complete' AS metadata_status, 'Electronic' AS genre, NULL::BIGINT AS release_year
  FROM songs s JOIN part ON p_partkey = s.id * 3)"""


def _crawled(spark, sf):
    n = F.col("p_partkey")
    tracks = V.table(spark, sf, "part").select(
        n.alias("deezer_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.when(n % 3 == 0, "").otherwise(F.col("p_type")).alias("album"),
        F.col("p_size").alias("duration"), (n % 150).cast("int").alias("genre_id"),
        F.lit(None).cast("int").alias("release_year"))
    feats = _track_features(spark, sf).withColumnsRenamed(
        {"track_id": "deezer_id", "duration": "feature_duration"})
    return K.crawled_songs(feats, tracks)


@query("j1_h6_unify", "WITH " + ", ".join((FMA_SQL, JAM_SQL, CRAWL_SQL)) + """
SELECT source, metadata_status, count(*) AS n, count(album) AS albums,
  round(sum(duration_sec), 6) AS seconds, count(DISTINCT genre) AS genres FROM (
  SELECT * EXCLUDE (track_id) FROM fma_songs UNION ALL BY NAME
  SELECT * EXCLUDE (track_id) FROM jam_songs UNION ALL BY NAME
  SELECT * EXCLUDE (deezer_id) FROM crawl_songs) GROUP BY ALL""")
def j1(spark, sf):
    fma = K.fma_songs(_track_features(spark, sf), _track_meta(spark, sf)).drop("track_id")
    both = K.unify(fma, _jamendo(spark, sf).drop("track_id"), _crawled(spark, sf))
    return both.groupBy("source", "metadata_status").agg(
        F.count("*").alias("n"), F.count("album").alias("albums"),
        F.round(F.sum("duration_sec"), 6).alias("seconds"),
        F.count_distinct("genre").alias("genres"))


@query("f5_audio_of_selection", f"""
SELECT doc_id AS track_id FROM documents WHERE doc_id % 11 <> 0 AND doc_id IN (
  SELECT track_id FROM track_meta WHERE release_year >= 2000 AND (genre IN ({quoted(ALLOWED)})
    OR sub_genre IN ({quoted(ALLOWED)})))""")
def f5(spark, sf):
    chosen = LS.select_tracks(_track_meta(spark, sf), ALLOWED, None, 2000)
    files = RD.audio_inventory(_audio_files(spark, sf))
    return files.join(chosen, "track_id", "left_semi").select("track_id")


@query("f6_not_in_catalogue", "WITH " + INCOMING_CTE + """
SELECT seq, deezer_id FROM incoming WHERE deezer_id IS NOT NULL AND deezer_id NOT IN (
  SELECT deezer_id FROM songs WHERE deezer_id IS NOT NULL)""")
def f6(spark, sf):
    known = V.vectors(spark, sf).where(F.col("deezer_id").isNotNull())
    rows = _incoming(spark, sf).where(F.col("deezer_id").isNotNull())
    return K.pending(rows, known, "deezer_id").select("seq", "deezer_id")


@query("f7_h3_pending_work", """
SELECT id FROM songs WHERE mert IS NULL AND deezer_id IS NOT NULL
  AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def f7(spark, sf):
    done = V.table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("id"))
    return K.pending(LS.vector_backlog(V.songs(spark, sf)), done, "id").select("id")


@query("f11_genre_parents", f"""
SELECT {GENRE_SQL.format(k='p_partkey')} AS title, {GENRE_SQL.format(k='p_partkey // 8')} AS top
FROM part""")
def f11(spark, sf):
    return K.genre_parents(_genres(spark, sf))


@query("i10_first_known_genre", """
SELECT track_id, sub_genre, genre FROM track_meta WHERE sub_genre IS NOT NULL""")
def i10(spark, sf):
    tracks = _tracks(spark, sf).withColumn("genre_titles", X.genre_titles("track_genres"))
    return K.track_genres(tracks, K.genre_parents(_genres(spark, sf)))


@query("h4_distinct_tracks", "SELECT DISTINCT track_id FROM graph WHERE preview IS NOT NULL")
def h4(spark, sf):
    g = V.artist_graph(spark, sf)
    return g["tracks"].where(F.col("preview").isNotNull()).select("track_id").dropDuplicates()


@query("h5_common_ids", "SELECT id FROM songs WHERE mert IS NOT NULL AND deezer_id IS NOT NULL")
def h5(spark, sf):
    songs = V.vectors(spark, sf)
    return E.common_ids(songs.where(F.col("mert").isNotNull()),
                        songs.where(F.col("deezer_id").isNotNull()))


# ------------------------------------------------------------------------ jobs (J)

@query("j3_apply_genres", """
WITH u AS (SELECT user_id AS id, max_by('u' || event_type, event_id) AS genre FROM events GROUP BY ALL)
SELECT s.id, coalesce(u.genre, s.genre) AS genre FROM songs s LEFT JOIN u USING (id)""")
def j3(spark, sf):
    updates = V.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.concat(F.lit("u"), F.col("event_type")).alias("genre"),
        F.col("event_id").alias("seq"))
    return K.apply_genres(V.vectors(spark, sf), updates).select("id", "genre")


@query("j4_f8_backfill_external_id", "WITH " + MAPPING_CTE + """,
one AS (SELECT title, artist, min_by(deezer_id, fl) AS deezer_id FROM mapping GROUP BY ALL),
target AS (SELECT title, artist, min(id) AS id FROM songs WHERE deezer_id IS NULL GROUP BY ALL)
SELECT id, deezer_id FROM target JOIN one USING (title, artist)""")
def j4(spark, sf):
    mapping = K.external_id_mapping(_mapping_lines(spark, sf))
    return K.backfill_external_id(V.songs(spark, sf), mapping)


@query("j5_f12_backfill_genre", """
WITH ids AS (SELECT [106,129,85,464,2,113,98] AS ids),
names(gid, label) AS (VALUES (106,'Electro'),(129,'Jazz'),(85,'Alternative'),(464,'Metal'),
  (2,'Country'),(113,'Dance'),(98,'Reggae'))
SELECT s.id, deezer_id, s.genre, CASE WHEN s.id % 9 = 0 THEN NULL
    WHEN p_partkey IS NULL THEN 'Electronic' ELSE coalesce(label, 'Electronic') END AS new_genre,
  CASE WHEN s.id % 9 = 0 THEN 'failed' WHEN p_partkey IS NULL THEN 'unchanged' ELSE 'updated' END
    AS outcome
FROM (SELECT * REPLACE ('Electronic' AS genre) FROM songs WHERE deezer_id IS NOT NULL) s
LEFT JOIN part ON p_partkey = s.id * 5 LEFT JOIN names ON gid = (SELECT ids FROM ids)[s.id * 5 % 7 + 1]""")
def j5(spark, sf):
    songs = V.songs(spark, sf).withColumn("genre", F.lit(X.FALLBACK_GENRE))
    n = F.col("id")
    tracks = songs.where(n % 9 != 0).select("deezer_id", (n * 5).alias("album_id"))
    return K.backfill_genre(songs, tracks, V.artist_graph(spark, sf)["albums"])


@query("j6_update_vectors", f"""
SELECT id, {digest_sql('CASE WHEN mert IS NOT NULL THEN mert WHEN id % 7 <> 0 AND id % 5 <> 0 '
                       'AND id % 3 <> 0 AND id % 11 <> 0 THEN learned END')} AS mert FROM songs""")
def j6(spark, sf):
    songs = V.vectors(spark, sf)
    done = songs.where("id % 11 = 0").select("id")
    return K.update_vectors(songs, _vector_results(songs), "mert", done).select(
        "id", digest("mert").alias("mert"))


@query("j8_renormalise", "WITH " + STATS_CTE + """
SELECT id, round(sum((x - m) / s * i), 6) AS v FROM cells JOIN st USING (i) GROUP BY id""")
def j8(spark, sf):
    return ST.renormalise(V.vectors(spark, sf)).select("id", digest("handcrafted_norm").alias("v"))


@query("j9_f14_expand_catalog", """
WITH d0 AS (SELECT s_suppkey AS artist_id FROM supplier WHERE s_nationkey = 3),
d1 AS (SELECT DISTINCT related_id AS artist_id FROM related JOIN d0 USING (artist_id)
  WHERE related_id NOT IN (SELECT artist_id FROM d0) AND related_id IN (SELECT artist_id FROM gate)),
d2 AS (SELECT DISTINCT related_id AS artist_id FROM related JOIN d1 USING (artist_id)
  WHERE related_id NOT IN (SELECT artist_id FROM d0) AND related_id NOT IN (SELECT artist_id FROM d1)
    AND related_id IN (SELECT artist_id FROM gate)),
reached AS (SELECT *, 0 AS depth FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2)
SELECT track_id, artist_id, depth::BIGINT AS depth, title FROM graph JOIN reached USING (artist_id)
WHERE pos <= 50 AND preview IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY depth, artist_id, pos) = 1""")
def j9(spark, sf):
    g = V.artist_graph(spark, sf)
    seeds = V.table(spark, sf, "supplier").where("s_nationkey = 3").select(
        F.col("s_suppkey").alias("artist_id"))
    out = EX.expand_catalog(seeds, g["related"], g["tracks"], g["albums"], depth=2, top=50, fan=20)
    return longs(out.select("track_id", "artist_id", "depth", "title"), "depth")


@query("j9_new_tracks_of_artists", """
SELECT artist_id, track_id FROM graph WHERE pos <= 10 AND preview IS NOT NULL
  AND track_id NOT IN (SELECT deezer_id FROM songs WHERE deezer_id IS NOT NULL)""")
def j9_one(spark, sf):
    g = V.artist_graph(spark, sf)
    return EX.new_tracks_of_artist(g["artists"], g["tracks"], V.vectors(spark, sf), 10).select(
        "artist_id", "track_id")


def work_list(spark, sf):
    n = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        n.alias("pos"), (n + 1200).alias("deezer_id"),
        F.when(n % 4 != 0, F.concat(F.lit("http://p/"), n.cast("string"))).alias("preview_url"))


@query("j10_feed", """
WITH w AS (SELECT p_partkey AS pos, p_partkey + 1200 AS deezer_id, p_partkey % 4 <> 0 AS preview,
    (p_partkey + 1200) IN (SELECT event_id FROM events WHERE event_type = 'view') AS seen FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY pos) AS n FROM w)
SELECT deezer_id, CASE WHEN seen THEN 'processed' WHEN n > 1000 THEN 'beyond_limit'
  WHEN deezer_id IN (SELECT deezer_id FROM songs WHERE deezer_id IS NOT NULL) THEN 'skipped'
  WHEN preview THEN 'queued' ELSE 'failed' END AS outcome FROM t""")
def j10(spark, sf):
    done = V.table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("event_id").alias("deezer_id"))
    return K.feed(work_list(spark, sf), V.vectors(spark, sf), done, 1000).select("deezer_id", "outcome")


REQ_CTE = NOISY_CTE + rf""", req0 AS (SELECT p_partkey AS request_id, p_partkey,
    CASE WHEN p_partkey % 12 = 11 THEN '' ELSE {VIDEO_SUFFIX_SQL.format('raw')} END AS t,
    trim(regexp_replace(author, '\s*-\s*Topic$', '', 'i')) AS who FROM noisy),
req1 AS (SELECT request_id,
  CASE WHEN contains(t, ' - ') THEN trim(split_part(t, ' - ', 1))
    WHEN contains(t, ' | ') THEN trim(split_part(t, ' | ', 1))
    WHEN regexp_matches(t, '^(.+?)\s+by\s+(.+)$', 'i')
      THEN trim(regexp_extract(t, '^(.+?)\s+by\s+(.+)$', 2, 'i')) ELSE who END AS artist,
  CASE WHEN contains(t, ' - ') THEN trim(substr(t, instr(t, ' - ') + 3))
    WHEN contains(t, ' | ') THEN trim(substr(t, instr(t, ' | ') + 3))
    WHEN regexp_matches(t, '^(.+?)\s+by\s+(.+)$', 'i')
      THEN trim(regexp_extract(t, '^(.+?)\s+by\s+(.+)$', 1, 'i')) ELSE t END AS title FROM req0),
req AS (SELECT request_id, artist, title, {CLEAN_TITLE_SQL.format('title')} AS qt0,
  lower({CLEAN_TITLE_SQL.format('title')}) AS qt, {CLEAN_ARTIST_SQL.format('artist')} AS qa FROM req1),
hit AS (SELECT r.request_id, r.qt, r.qa, s.id, lower(s.artist) AS la,
    row_number() OVER (PARTITION BY r.request_id ORDER BY s.id) AS n
  FROM req r JOIN songs s ON contains(lower(s.title), r.qt) WHERE r.qt <> ''),
t1 AS (SELECT request_id, min(id) AS id FROM hit WHERE qa <> '' AND contains(la, qa) GROUP BY ALL),
t2 AS (SELECT request_id, min(id) AS id FROM hit WHERE n <= 10
       AND (qa = '' OR """ + MATCH_SQL.format(a="qa", b="la") + """) GROUP BY ALL),
t3 AS (SELECT r.request_id, min(s.id) AS id FROM req r JOIN songs s ON contains(lower(s.artist), r.qa)
       WHERE r.qt = '' AND r.qa <> '' GROUP BY ALL),
found AS (SELECT r.request_id, r.artist, r.title, coalesce(t1.id, t2.id, t3.id) AS song_id,
    CASE WHEN t1.id IS NOT NULL THEN 1 WHEN t2.id IS NOT NULL THEN 2 WHEN t3.id IS NOT NULL THEN 3 END
      AS tier, qt, qa
  FROM req r LEFT JOIN t1 USING (request_id) LEFT JOIN t2 USING (request_id)
  LEFT JOIN t3 USING (request_id))"""


def _requests(spark, sf):
    n = F.col("p_partkey")
    tag = F.substring(F.md5(n.cast("string")), 1, 11)
    return _noisy(spark, sf).select(
        n.alias("request_id"),
        F.when(n % 10 == 9, F.lit("http://unknown.example/x")).otherwise(
            F.concat(F.lit("https://youtu.be/"), tag)).alias("url"),
        F.when(n % 12 == 11, "").otherwise(F.col("raw")).alias("raw_title"), "author")


@query("f9_identify", "WITH " + REQ_CTE + """
SELECT request_id, song_id, tier::BIGINT AS tier, song_id IS NOT NULL AS matched,
  song_id IS NULL AND qt <> '' AND qa <> '' AS needs_ingest FROM found""")
def f9(spark, sf):
    parsed = _requests(spark, sf).withColumn(
        "p", X.parse_video_title("raw_title", "author")).select(
        "request_id", F.col("p.artist").alias("artist"), F.col("p.title").alias("title"))
    return longs(ID.identify(parsed, V.songs(spark, sf), title_pool=10), "tier")


@query("j11_identify_links", "WITH " + REQ_CTE + """
SELECT request_id, CASE WHEN request_id % 10 <> 9 THEN 'youtube' END AS platform,
  CASE WHEN request_id % 10 <> 9 THEN song_id END AS song_id,
  CASE WHEN request_id % 10 <> 9 THEN tier END::BIGINT AS tier,
  request_id % 10 <> 9 AND song_id IS NOT NULL AS matched,
  request_id % 10 <> 9 AND song_id IS NULL AND qt <> '' AND qa <> '' AS needs_ingest FROM found""")
def j11(spark, sf):
    out = ID.identify_links(_requests(spark, sf), V.songs(spark, sf), title_pool=10)
    return longs(out.select("request_id", "platform", "song_id", "tier", "matched", "needs_ingest"),
                 "tier")


def _candidates(spark, sf):
    """Search hits: the lines of an order are the candidates for its request."""
    p = V.playlists(spark, sf)
    return p.select(
        F.col("playlist_id").alias("request_id"), F.col("position").alias("pos"),
        F.when(F.col("position") % 3 != 1, F.lit("http://p")).alias("preview"),
        F.lit("red").alias("want_title"), F.lit("Brand#1").alias("want_artist"),
        F.col("title").alias("cand_title"), F.col("artist").alias("cand_artist"))


@query("j12_choose_candidate", """
WITH c AS (SELECT *, CASE WHEN contains(lower(title), 'red') AND (contains(lower(artist), 'brand#1')
    OR contains('brand#1', lower(artist))) THEN 0 WHEN position % 3 <> 1 THEN 1 END AS tier FROM playlists)
SELECT playlist_id AS request_id, position AS pos, title AS cand_title, tier::BIGINT AS tier FROM c
WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY tier, position) = 1""")
def j12(spark, sf):
    return longs(K.choose_candidate(_candidates(spark, sf)).select(
        "request_id", "pos", "cand_title", "tier"), "tier", "pos")


@query("j13_enrich_uploads", """
SELECT md5(id::VARCHAR) AS job_id,
  coalesce(CASE WHEN p_partkey % 5 > 1 THEN nullif(p_name, '') END,
           'Upload ' || substr(md5(id::VARCHAR), 1, 8)) AS title,
  coalesce(CASE WHEN p_partkey % 5 > 0 THEN p_brand END, 'Unknown') AS artist,
  CASE WHEN p_partkey % 5 > 2 THEN p_type END AS album, 'uploaded' AS metadata_status
FROM songs LEFT JOIN part ON p_partkey = id * 5 + id % 5 AND id % 2 = 0""")
def j13(spark, sf):
    uploads = V.songs(spark, sf).select(F.md5(F.col("id").cast("string")).alias("job_id"), "bpm")
    n = F.col("p_partkey")
    owner = F.expr("p_partkey div 5")
    resolved = V.table(spark, sf, "part").where((n % 5 == owner % 5) & (owner % 2 == 0)).select(
        F.md5(owner.cast("string")).alias("job_id"), F.lit("r").alias("recording_id"),
        F.when(n % 5 > 1, F.col("p_name")).otherwise("").alias("title"),
        F.when(n % 5 > 0, F.col("p_brand")).alias("artist"),
        F.when(n % 5 > 2, F.col("p_type")).otherwise("").alias("album"))
    return K.enrich(uploads, resolved).select("job_id", "title", "artist", "album",
                                              "metadata_status")


STATE_SQL = """state AS (SELECT job_id, max_by(status, (updated_at, seq)) AS status,
    (max_by(progress, (updated_at, seq)) FILTER (progress IS NOT NULL)) AS progress,
    (max_by(audio_path, (updated_at, seq)) FILTER (audio_path IS NOT NULL)) AS audio_path,
    (max_by(result, (updated_at, seq)) FILTER (result IS NOT NULL)) AS result,
    (max_by(last_error, (updated_at, seq)) FILTER (last_error IS NOT NULL)) AS last_error,
    max(updated_at) AS updated_at,
    max(updated_at) FILTER (status IN ('completed', 'failed')) AS completed_at
  FROM job_events GROUP BY job_id)"""
TIME = "yyyy-MM-dd HH:mm:ss"


@query("j14_job_state", "WITH " + STATE_SQL + """
SELECT * REPLACE (strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
  strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at) FROM state""")
def j14(spark, sf):
    s = JB.job_state(V.job_events(spark, sf)).drop("created_at")
    return s.withColumn("updated_at", F.date_format("updated_at", TIME)).withColumn(
        "completed_at", F.date_format("completed_at", TIME))


NOW = "2001-06-01 00:00:00"


@query("k5_stalled_jobs", "WITH " + STATE_SQL + f"""
SELECT job_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, stale AS stalled,
  CASE WHEN stale THEN 'no update within the time allowed' ELSE last_error END AS error
FROM (SELECT *, status = 'processing' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND AS stale
      FROM state)""")
def k5(spark, sf):
    state = JB.job_state(V.job_events(spark, sf))
    return JB.stalled_jobs(state, F.lit(NOW)).select("job_id", "status", "stalled", "error")


@query("g7_retention_plan", f"""
WITH files AS (SELECT o_orderkey::VARCHAR AS stem, (o_totalprice * 100)::BIGINT AS size,
    o_orderdate AS modified, o_orderkey % 5 AS j FROM orders),
a AS (SELECT *, j IN (2, 3) AS active, CASE WHEN j IN (0, 1) THEN 'finished'
    WHEN j = 4 AND modified < TIMESTAMP '1998-01-01' - INTERVAL 86400 SECOND THEN 'orphan' END AS first
  FROM files),
rest AS (SELECT *, sum(size) OVER () AS total FROM a WHERE first IS NULL),
idle AS (SELECT *, coalesce(sum(size) OVER (ORDER BY modified, stem
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM rest WHERE NOT active)
SELECT stem, first AS action FROM a WHERE first IS NOT NULL
UNION ALL SELECT stem, 'keep' FROM rest WHERE active
UNION ALL SELECT stem, CASE WHEN total - gone > 120000000000 THEN 'over_cap' ELSE 'keep' END FROM idle""")
def g7(spark, sf):
    o = V.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    files = o.select(n.cast("string").alias("stem"),
                     F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
                     F.col("o_orderdate").alias("modified"))
    status = F.when(n % 5 == 0, "completed").when(n % 5 == 1, "failed").when(
        n % 5 == 2, "processing").otherwise("queued")
    jobs = o.where(n % 5 < 4).select(n.alias("job_id"), status.alias("status"))
    plan = JB.retention_plan(files, jobs, F.lit("1998-01-01"), cap_bytes=120_000_000_000)
    return plan.select("stem", "action")


@query("j15_resolve_artists", """
WITH c AS (SELECT p_brand AS q, p_partkey AS pos, p_partkey AS artist_id,
    CASE WHEN p_partkey % 40 = 7 THEN upper(p_brand) ELSE p_name END AS artist_name FROM part),
b AS (SELECT q, min_by((artist_id, artist_name), (lower(artist_name) <> lower(q), pos)) AS best
  FROM c GROUP BY ALL),
names AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT s_name FROM supplier)
SELECT name, struct_extract(best, 1) AS artist_id, struct_extract(best, 2) AS artist_name
FROM names LEFT JOIN b ON q = name""")
def j15(spark, sf):
    p = V.table(spark, sf, "part")
    n = F.col("p_partkey")
    cands = p.select(
        F.col("p_brand").alias("query_name"), n.alias("pos"), n.alias("artist_id"),
        F.when(n % 40 == 7, F.upper("p_brand")).otherwise(F.col("p_name")).alias("artist_name"))
    names = p.select(F.col("p_brand").alias("name")).union(
        V.table(spark, sf, "supplier").select("s_name")).distinct()
    return EX.resolve_artists(names, cands)
