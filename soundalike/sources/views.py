"""Domain views over the benchmark tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TONICS = ("A-flat", "A", "B-flat", "B", "C", "C#", "D", "E-flat", "E", "F", "F#", "G")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str, named: bool = True) -> DataFrame:
    """Catalogue: one song per embedding, three versions per part name.

    With ``named=False`` title, artist and album are left out, and with them the join.
    """
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    third = n % 3
    names = []
    if named:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
        e = e.withColumn("p_partkey", F.expr("vec_id div 3")).join(p, "p_partkey", "left")
        names = [
            F.concat(F.coalesce("p_name", F.lit("untitled")),
                     F.when(third == 0, " (Extended Mix)").when(third == 1, " - Radio Edit")
                     .otherwise("")).alias("title"),
            F.coalesce("p_brand", F.lit("Unknown")).alias("artist"),
            F.col("p_type").alias("album")]
    key = F.concat_ws(" ", F.get(F.array(*map(F.lit, TONICS)), (n % 12).cast("int")),
                      F.when(n % 24 < 12, "major").otherwise("minor"))
    vec = F.col("embedding").cast("array<double>")
    raw = F.slice(vec, 1, 44)
    return (
        e.select(
            n.alias("id"), *names,
            (F.lit(120.0) + n % 240).alias("duration_sec"),
            F.when(n % 37 != 0, F.lit(60.0) + n % 140).alias("bpm"),
            key.alias("musical_key"),
            F.when(n % 41 != 0, F.concat(F.lit("g"), F.col("label").cast("string"))).alias("genre"),
            F.when(n % 53 == 0, "failed").otherwise("complete").alias("metadata_status"),
            F.when(n % 5 != 0, 1000 + n).alias("deezer_id"),
            vec.alias("learned"), raw.alias("handcrafted_raw"),
            F.transform(raw, lambda x: x * 8).alias("handcrafted_norm"),
            F.when(n % 2 == 0, F.reverse(vec)).alias("mert"),
            (F.lit("2024-01-01").cast("timestamp")
             + F.make_dt_interval(secs=((n * 7919) % 100000).cast("decimal(18,6)"))
             ).alias("created_at")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue without names."""
    return songs(spark, sf_dir, named=False)


SONGS_SQL = """songs AS (
  SELECT vec_id AS id,
    coalesce(p_name, 'untitled') || CASE vec_id % 3 WHEN 0 THEN ' (Extended Mix)'
      WHEN 1 THEN ' - Radio Edit' ELSE '' END AS title,
    coalesce(p_brand, 'Unknown') AS artist, p_type AS album,
    120.0::DOUBLE + vec_id % 240 AS duration_sec,
    CASE WHEN vec_id % 37 <> 0 THEN 60.0::DOUBLE + vec_id % 140 END AS bpm,
    (['A-flat','A','B-flat','B','C','C#','D','E-flat','E','F','F#','G'])[vec_id % 12 + 1]
      || CASE WHEN vec_id % 24 < 12 THEN ' major' ELSE ' minor' END AS musical_key,
    CASE WHEN vec_id % 41 <> 0 THEN 'g' || label END AS genre,
    CASE WHEN vec_id % 53 = 0 THEN 'failed' ELSE 'complete' END AS metadata_status,
    CASE WHEN vec_id % 5 <> 0 THEN 1000 + vec_id END AS deezer_id,
    embedding::DOUBLE[] AS learned,
    (embedding::DOUBLE[])[1:44] AS handcrafted_raw,
    list_transform((embedding::DOUBLE[])[1:44], lambda x: x * 8) AS handcrafted_norm,
    CASE WHEN vec_id % 2 = 0 THEN list_reverse(embedding::DOUBLE[]) END AS mert,
    TIMESTAMP '2024-01-01' + to_seconds((vec_id * 7919) % 100000) AS created_at
  FROM embeddings LEFT JOIN part ON p_partkey = vec_id // 3)"""


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


FOCI = ("timbre", "harmony", "rhythm", "brightness", "intensity")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes: purchases and clicks are positive, errors negative."""
    e = table(spark, sf_dir, "events")
    k = _k()
    rating = (F.when(F.col("event_type").isin("purchase", "click"), 1)
              .when(F.col("event_type") == "error", -1))
    return (e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("query_song_id"),
        (F.col("user_id") * 7 + k % 20).alias("result_song_id"), rating.alias("rating"),
        F.get(F.array(*map(F.lit, FOCI)), (k % 6).cast("int")).alias("focus_active"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"),
        F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("ab_group"),
        F.col("ts").cast("timestamp").alias("created_at")).where(F.col("rating").isNotNull()))


FEEDBACK_SQL = """feedback AS (
  SELECT * FROM (
    SELECT event_id AS id, user_id AS query_song_id,
      user_id * 7 + (props->>'$.k')::BIGINT % 20 AS result_song_id,
      CASE WHEN event_type IN ('purchase', 'click') THEN 1 WHEN event_type = 'error' THEN -1 END
        AS rating,
      CASE WHEN (props->>'$.k')::BIGINT % 6 < 5 THEN
        (['timbre','harmony','rhythm','brightness','intensity'])[(props->>'$.k')::BIGINT % 6 + 1]
      END AS focus_active,
      '10.0.0.' || (user_id % 250) AS ip,
      CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS ab_group, ts AS created_at
    FROM events) WHERE rating IS NOT NULL)"""

# Fixed mapping of event types to click actions ('signup' is not an action).
ACTIONS = {"view": "play", "click": "similar", "purchase": "playlist", "error": "feedback_down",
           "signup": "signup"}


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = _k()
    action = F.lit(None).cast("string")
    for event, name in ACTIONS.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_hash"),
        F.col("user_id").alias("query_song_id"), (F.col("user_id") * 7 + k % 20).alias(
            "result_song_id"),
        k.cast("int").alias("result_rank"),
        F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("ab_group"),
        action.alias("action"), F.col("ts").cast("timestamp").alias("created_at"))


CLICKS_SQL = """clicks AS (
  SELECT event_id AS id, 's' || user_id AS session_hash, user_id AS query_song_id,
    user_id * 7 + (props->>'$.k')::BIGINT % 20 AS result_song_id,
    (props->>'$.k')::INT AS result_rank,
    CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS ab_group,
    CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'similar'
      WHEN 'purchase' THEN 'playlist' WHEN 'error' THEN 'feedback_down' ELSE 'signup' END AS action,
    ts AS created_at
  FROM events)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: the orders of a customer are the updates of one job."""
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "completed")
              .when(F.col("o_orderstatus") == "O", "processing").otherwise("queued"))
    n = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("job_id"), n.alias("seq"), status.alias("status"),
        F.when(n % 3 != 0, (n % 100) / 100.0).alias("progress"),
        F.when(n % 4 == 0, F.concat(F.lit("/jobs/"), n.cast("string"))).alias("audio_path"),
        F.when(status == "completed", F.concat(F.lit("r"), n.cast("string"))).alias("result"),
        F.when(n % 11 == 0, "decode error").alias("last_error"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))


JOB_EVENTS_SQL = """job_events AS (
  SELECT o_custkey AS job_id, o_orderkey AS seq,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'queued' END
      AS status,
    CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS progress,
    CASE WHEN o_orderkey % 4 = 0 THEN '/jobs/' || o_orderkey END AS audio_path,
    CASE WHEN o_orderstatus = 'F' THEN 'r' || o_orderkey END AS result,
    CASE WHEN o_orderkey % 11 = 0 THEN 'decode error' END AS last_error,
    o_orderdate AS updated_at
  FROM orders)"""


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist entries: the lines of an order, in a total order."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    n = F.col("l_partkey")
    return (li.withColumn("position", F.row_number().over(w))
            .join(p, F.col("p_partkey") == n)
            .select(F.col("l_orderkey").alias("playlist_id"), "position", n.alias("song_id"),
                    F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
                    F.when(n % 17 != 0, F.lit(60.0) + n % 140).alias("bpm"),
                    F.when(n % 13 != 0, F.concat_ws(
                        " ", F.get(F.array(*map(F.lit, TONICS)), (n % 12).cast("int")),
                        F.when(n % 24 < 12, "major").otherwise("minor"))).alias("musical_key"),
                    (F.col("p_size") / 50.0).alias("intensity")))


PLAYLISTS_SQL = """playlists AS (
  SELECT l_orderkey AS playlist_id, position, l_partkey AS song_id, p_brand AS artist,
    p_name AS title,
    CASE WHEN l_partkey % 17 <> 0 THEN 60.0::DOUBLE + l_partkey % 140 END AS bpm,
    CASE WHEN l_partkey % 13 <> 0 THEN
      (['A-flat','A','B-flat','B','C','C#','D','E-flat','E','F','F#','G'])[l_partkey % 12 + 1]
      || CASE WHEN l_partkey % 24 < 12 THEN ' major' ELSE ' minor' END END AS musical_key,
    p_size / 50.0::DOUBLE AS intensity
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS position
        FROM lineitem) JOIN part ON p_partkey = l_partkey)"""


# Tables derived for the metadata, graph and upload operators.

def genre_name(k: F.Column) -> F.Column:
    return F.concat(F.when(k % 5 == 0, "Child's play ").otherwise("Genre "), k.cast("string"))


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of a raw track table, one row per part."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")

    def record(k: F.Column) -> F.Column:
        quote = F.when(k % 5 == 0, '"').otherwise("'")
        return F.concat(F.lit("{'genre_id': '"), k.cast("string"), F.lit("', 'genre_title': "),
                        quote, genre_name(k), quote, F.lit(", 'genre_url': 'http://x/'}"))

    literal = F.when(n % 9 == 0, "[{'genre_title': 'Broken'").otherwise(
        F.concat(F.lit("["), record(n * 3), F.lit(", "), record(n), F.lit("]")))
    date = F.concat(F.lit("7/4/"), (1990 + n % 30).cast("string"), F.lit(" 01:48:12 AM"))
    return p.select(
        F.when(n % 50 == 49, F.concat(F.lit("x"), n.cast("string"))).otherwise(
            n.cast("string")).alias("track_id"),
        F.when(n % 13 == 0, "").when(n % 17 == 0, F.concat(
            F.lit('He said "go",\n'), F.col("p_name"))).otherwise(F.col("p_name")).alias("track_title"),
        F.when(n % 19 == 0, "").otherwise(F.col("p_brand")).alias("artist_name"),
        F.when(n % 3 == 0, "").otherwise(F.col("p_type")).alias("album_title"),
        F.concat_ws(":", (n % 9).cast("string"), F.lpad(F.col("p_size").cast("string"), 2, "0")
                    ).alias("track_duration"),
        literal.alias("track_genres"),
        F.when(n % 2 == 0, date).otherwise("").alias("track_date_recorded"),
        date.alias("track_date_created"))


_GENRE_SQL = "(CASE WHEN ({k}) % 5 = 0 THEN 'Child''s play ' ELSE 'Genre ' END || ({k}))"
TRACK_META_SQL = f"""track_meta AS (
  SELECT p_partkey AS track_id,
    CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0
      THEN 'He said "go",' || chr(10) || p_name ELSE p_name END AS track_title,
    CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_brand END AS artist_name,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS album_title,
    ((p_partkey % 9) * 60 + p_size)::DOUBLE AS duration_sec,
    CASE WHEN p_partkey % 9 = 0 THEN NULL
      WHEN p_partkey * 3 <= (SELECT max(p_partkey) FROM part)
      THEN {_GENRE_SQL.format(k='p_partkey * 3')} ELSE {_GENRE_SQL.format(k='p_partkey')} END
      AS sub_genre,
    CASE WHEN p_partkey % 9 = 0 THEN NULL
      WHEN p_partkey * 3 <= (SELECT max(p_partkey) FROM part)
      THEN {_GENRE_SQL.format(k='p_partkey * 3 // 8')} ELSE {_GENRE_SQL.format(k='p_partkey // 8')}
      END AS genre,
    (1990 + p_partkey % 30)::BIGINT AS release_year
  FROM part WHERE p_partkey % 50 <> 49)"""


def genre_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One genre per part; eight genres share a parent."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.cast("int").alias("genre_id"), genre_name(n).alias("title"),
        F.expr("cast(p_partkey div 8 as int)").alias("top_level"))


TAG_NAMES = ("techno", "house", "ambient", "idm", "rock", "pop", "folk", "club", "edm", "jazz")


def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged tab-separated tag lines, one per document."""
    n = F.col("doc_id")
    names = F.array(*map(F.lit, TAG_NAMES))
    tags = [F.concat(F.lit("genre---"), F.get(names, ((n * k) % 10).cast("int"))) for k in (3, 7)]
    num = n.cast("string")
    return table(spark, sf_dir, "documents").select(F.when(n % 10 == 9, F.concat_ws(
        "\t", F.concat(F.lit("track_"), num), F.lit("a"), F.lit("b"))).otherwise(F.concat_ws(
            "\t", F.concat(F.lit("track_"), num), F.lit("a"), F.lit("b"),
            F.concat(F.lit("14/"), num, F.lit(".mp3")),
            F.when(n % 7 == 0, "bad").otherwise((F.col("n_chars") / 8).cast("string")),
            tags[0], F.lit("mood---calm"), F.when(n % 2 == 0, tags[1]))).alias("value"))


TAG_ROWS_SQL = """tag_rows AS (
  SELECT 'track_' || doc_id AS track_id, '14/' || doc_id || '.mp3' AS path, doc_id,
    CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars / 8 END AS tag_duration,
    list_concat([names[doc_id * 3 % 10 + 1]],
                CASE WHEN doc_id % 2 = 0 THEN [names[doc_id * 7 % 10 + 1]] ELSE [] END) AS tags
  FROM documents, (SELECT ['techno','house','ambient','idm','rock','pop','folk','club','edm','jazz']
                   AS names)
  WHERE doc_id % 10 <> 9)"""


def meta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    num = n.cast("string")
    return table(spark, sf_dir, "documents").select(F.concat_ws(
        "\t", F.concat(F.lit("track_"), num), F.lit("a"), F.lit("b"),
        F.when(n % 6 == 0, "").otherwise(F.concat_ws(" ", "source", num)), F.col("lang"),
        F.col("source"), F.when(n % 8 == 0, "unknown").otherwise(F.concat(
            (1995 + n % 25).cast("string"), F.lit("-12-28")))).alias("value"))


META_ROWS_SQL = """meta_rows AS (
  SELECT 'track_' || doc_id AS track_id,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE source || ' ' || doc_id END AS title,
    lang AS artist, source AS album,
    CASE WHEN doc_id % 8 <> 0 THEN 1995 + doc_id % 25 END::BIGINT AS release_year FROM documents)"""


def artist_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Suppliers as artists, their best-selling parts as top tracks, parts as albums."""
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.count("*").alias("n"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey")
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    tracks = (li.withColumn("pos", F.row_number().over(w)).join(p, n == F.col("l_partkey"))
              .select(F.col("l_suppkey").alias("artist_id"), "pos", n.alias("track_id"),
                      F.col("p_name").alias("title"), n.alias("album_id"),
                      F.when(n % 4 != 0, F.concat(F.lit("http://p/"), n.cast("string"))
                             ).alias("preview")))
    ids = F.array(F.lit(106), F.lit(129), F.lit(85), F.lit(464), F.lit(2), F.lit(113), F.lit(98))
    albums = p.select(
        n.alias("album_id"), F.get(ids, (n % 7).cast("int")).alias("genre_id"),
        F.array(F.struct(F.get(ids, (n * 3 % 7 + n % 2).cast("int")).alias("id"),
                         F.lit("x").alias("name"))).alias("genres"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_id"))
    a = F.col("artist_id")
    related = s.select("artist_id", F.posexplode(F.array(a + 1, a * 2, F.expr("artist_id div 2"))
                                                 ).alias("pos", "related_id"))
    related = (related.withColumn("pos", F.col("pos") + 1)
               .where(F.col("related_id") != a)
               .join(s.withColumnRenamed("artist_id", "related_id"), "related_id", "left_semi"))
    return {"artists": s, "tracks": tracks, "albums": albums, "related": related}


GRAPH_SQL = """graph AS (
  SELECT l_suppkey AS artist_id, row_number() OVER (
      PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS pos, l_partkey AS track_id, p_name AS title,
    CASE WHEN l_partkey % 4 <> 0 THEN 'http://p/' || l_partkey END AS preview,
    list_has_any([ids[l_partkey % 7 + 1], ids[l_partkey * 3 % 7 + l_partkey % 2 + 1]],
                 [106, 113, 85]) AS electronic
  FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)
  JOIN part ON p_partkey = l_partkey, (SELECT [106,129,85,464,2,113,98] AS ids)),
related AS (
  SELECT artist_id, pos, related_id FROM (
    SELECT s_suppkey AS artist_id, unnest([s_suppkey + 1, s_suppkey * 2, s_suppkey // 2]) AS related_id,
      unnest([1, 2, 3]) AS pos FROM supplier)
  WHERE related_id <> artist_id AND related_id IN (SELECT s_suppkey FROM supplier)),
gate AS (SELECT artist_id FROM graph WHERE pos = 1 AND coalesce(electronic, false))"""
