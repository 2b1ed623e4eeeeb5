"""Registered queries of the column expressions (C and I) over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundalike.functions import harmonic as H
from soundalike.functions import layout as L
from soundalike.functions import links as LK
from soundalike.functions import sql as SQL
from soundalike.functions import text as X
from soundalike.functions import vectors as C
from soundalike.operators import feedback as FB
from soundalike.operators import names
from soundalike.operators import playlist as PL
from soundalike.operators import rank as R
from soundalike.operators import stats as ST
from soundalike.plans.registry import query
from soundalike.plans.retrieval_queries import (
    BASE_TITLE, CAMELOT_CTE, WEIGHTS_CTE, bpm_sql, category_cosine, compat_sql)
from soundalike.sources import views as V


# ------------------------------------------------------------------ vectors (C)

def digest(v):
    """One number that depends on every element and its position."""
    return F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0),
                               lambda s, x: s + x), 6)


def digest_sql(v: str) -> str:
    return f"round(list_sum(list_transform({v}, lambda x, i: x * i)), 6)"


def song_pairs(spark, sf):
    """Each song with its successor."""
    songs = V.songs(spark, sf)
    cols = ("learned", "handcrafted_norm", "musical_key", "bpm", "artist", "genre")
    a = songs.select("id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = songs.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, "id")


PAIRS = "FROM songs a JOIN songs b ON b.id = a.id + 1"


@query("c1_cosine", f"SELECT a.id, round(list_cosine_similarity(a.learned, b.learned), 6) AS v {PAIRS}")
def c1(spark, sf):
    return song_pairs(spark, sf).select("id", F.round(C.cosine("a_learned", "b_learned"), 6).alias("v"))


@query("c2_cosine_distance",
       f"SELECT a.id, round(1 - list_cosine_similarity(a.learned, b.learned), 6) AS v {PAIRS}")
def c2(spark, sf):
    return song_pairs(spark, sf).select(
        "id", F.round(C.cosine_distance("a_learned", "b_learned"), 6).alias("v"))


@query("c3_gather", f"""
SELECT id, {digest_sql('[handcrafted_norm[41], handcrafted_norm[44]]')} AS rhythm,
  {digest_sql('handcrafted_norm[27:38]')} AS harmony,
  len(list_filter([handcrafted_norm[1], handcrafted_norm[100]], lambda x: x IS NOT NULL))::BIGINT
    AS kept FROM songs""")
def c3(spark, sf):
    h = "handcrafted_norm"
    return V.vectors(spark, sf).select(
        "id", digest(C.gather(h, L.FOCUS["rhythm"])).alias("rhythm"),
        digest(C.gather(h, L.FOCUS["harmony"])).alias("harmony"),
        F.size(C.gather(h, (0, 99))).cast("long").alias("kept"))


@query("c4_parse_vector", f"SELECT id, {digest_sql('learned')} AS v FROM songs")
def c4(spark, sf):
    text = V.vectors(spark, sf).select("id", F.to_json("learned").alias("t"))
    return text.select("id", digest(C.parse_vector("t")).alias("v"))


@query("c5_midpoint", f"""SELECT a.id, {digest_sql(
    'list_transform(list_zip(a.learned, b.learned), lambda p: (p[1] + p[2]) / 2)')} AS v {PAIRS}""")
def c5(spark, sf):
    return song_pairs(spark, sf).select("id", digest(C.midpoint("a_learned", "b_learned")).alias("v"))


MEAN_SQL = """SELECT {key}, round(sum(x * i), 6) AS v FROM (
  SELECT {key}, i, avg(x) AS x FROM (
    SELECT {key}, unnest(learned) AS x, unnest(range(1, len(learned) + 1)) AS i FROM songs)
  GROUP BY ALL) GROUP BY ALL"""


@query("c6_mean_vector", MEAN_SQL.format(key="genre"))
def c6(spark, sf):
    return ST.mean_vector(V.vectors(spark, sf), ["genre"], "learned").select(
        "genre", digest("vector").alias("v"))


@query("c7_mean_pool", MEAN_SQL.format(key="artist"))
def c7(spark, sf):
    """Frames of a track, pooled to one vector per track (artists stand for tracks)."""
    frames = V.songs(spark, sf).select("artist", F.col("id").alias("frame"), "learned")
    return ST.mean_vector(frames, ["artist"], "learned").select("artist", digest("vector").alias("v"))


FOLD_SQL = "list_transform(range(0, 12), lambda i: {v}[3*i+1] + {v}[3*i+2] + {v}[3*i+3])"


@query("c8_fold_chroma", f"SELECT id, {digest_sql(FOLD_SQL.format(v='learned'))} AS v FROM songs")
def c8(spark, sf):
    return V.vectors(spark, sf).select(
        "id", digest(C.fold_chroma(F.slice("learned", 1, 36))).alias("v"))


@query("c9_assemble", f"""SELECT id, {digest_sql(
    'list_concat(list_concat(list_concat(learned[1:13], '
    'list_transform(learned[1:13], lambda x: abs(x))), '
    + FOLD_SQL.format(v='learned') + '), learned[59:64])')} AS v FROM songs""")
def c9(spark, sf):
    mean = F.slice("learned", 1, 13)
    cov = F.transform(mean, lambda x: F.transform(mean, lambda y: x * y))
    vec = C.assemble(mean, cov, F.slice("learned", 1, 36),
                     [F.get("learned", F.lit(i)) for i in range(58, 64)])
    return V.vectors(spark, sf).select("id", digest(vec).alias("v"))


STATS_CTE = """cells AS (SELECT id, unnest(handcrafted_raw) AS x, unnest(range(1, 45)) AS i FROM songs),
  st AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-10) AS s, count(*) AS n
         FROM cells GROUP BY i)"""


@query("c10_zscore", "WITH " + STATS_CTE + """
SELECT id, round(sum((x - m) / s * i), 6) AS v FROM cells JOIN st USING (i) GROUP BY id""")
def c10(spark, sf):
    songs = V.vectors(spark, sf)
    out = ST.normalised(songs, ST.fit_stats(songs))
    return out.select("id", digest("handcrafted_norm").alias("v"))


_A, _B = "a.handcrafted_norm", "b.handcrafted_norm"


@query("c11_feature_similarity", "WITH " + WEIGHTS_CTE + f"""
SELECT a.id, round(list_cosine_similarity({_A}, {_B}), 6) AS whole,
  round({category_cosine('rhythm', _A, _B)}, 6) AS rhythm,
  round(CASE WHEN total IS NULL THEN list_cosine_similarity({_A}, {_B}) ELSE """ + " + ".join(
    f"w_{c} / (" + " + ".join(f"w_{x}" for x in L.FOCUS) + f") * {category_cosine(c, _A, _B)}"
    for c in L.FOCUS) + f" END, 6) AS weighted {PAIRS} LEFT JOIN wide ON wide.genre = a.genre")
def c11(spark, sf):
    songs = V.vectors(spark, sf)
    maps = R.weight_maps(FB.genre_focus_weights(V.feedback(spark, sf), songs))
    pairs = song_pairs(spark, sf).withColumn("genre", F.col("a_genre")).join(maps, "genre", "left")
    a, b = "a_handcrafted_norm", "b_handcrafted_norm"
    return pairs.select(
        "id", F.round(C.feature_similarity(a, b), 6).alias("whole"),
        F.round(C.feature_similarity(a, b, focus="rhythm"), 6).alias("rhythm"),
        F.round(C.feature_similarity(a, b, weights="weights"), 6).alias("weighted"))


@query("c12_unit", f"""SELECT id, {digest_sql(
    'list_transform(handcrafted_norm, lambda x: x / sqrt(list_dot_product(handcrafted_norm, handcrafted_norm)))')}
  AS v FROM songs""")
def c12(spark, sf):
    return V.vectors(spark, sf).select("id", digest(C.unit("handcrafted_norm")).alias("v"))


@query("c13_grouped_similarity", "SELECT a.id, round(" + " + ".join(
    f"{w} * list_cosine_similarity({_A}[{lo + 1}:{hi}], {_B}[{lo + 1}:{hi}])"
    for lo, hi, w in ((0, 13, .3), (13, 26, .1), (26, 38, .25), (38, 40, .2)))
    + f""" + 0.15 * (0.5 * (1 - least(abs({_A}[41] - {_B}[41]) / 50, 1))
      + 0.5 * list_cosine_similarity({_A}[42:44], {_B}[42:44])), 6) AS v {PAIRS}""")
def c13(spark, sf):
    return song_pairs(spark, sf).select("id", F.round(
        C.grouped_similarity("a_handcrafted_norm", "b_handcrafted_norm"), 6).alias("v"))


@query("c14_valid_vector", """
SELECT id, id % 7 <> 0 AND id % 11 <> 0 AS ok FROM songs""")
def c14(spark, sf):
    v = (F.when(F.col("id") % 7 == 0, F.slice("learned", 1, 60))
         .when(F.col("id") % 11 == 0, F.transform("learned", lambda x, i: F.when(
             i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("learned")))
    return V.vectors(spark, sf).select("id", C.valid_vector(v, 64).alias("ok"))


# --------------------------------------------------------------------- text (I)

TITLE_FORMS = (
    "{t} (Official Video)", "{t} [HQ]", "{a} - {t} (Official Audio)", "{a} | {t}", "{t} by {a}",
    "{t} ft. {a}", "{t} - Remastered", "{t} (Remix) [Mix Cut]", "{t} featuring {a}",
    "{t} - Radio Edit", "{a} - {t} [4K Remaster 2011]", "{t}")


def _noisy(spark, sf):
    p = V.table(spark, sf, "part")
    pattern = F.get(F.array(*map(F.lit, TITLE_FORMS)),
                    (F.col("p_partkey") % len(TITLE_FORMS)).cast("int"))
    form = F.replace(F.replace(pattern, F.lit("{t}"), F.col("p_name")), F.lit("{a}"),
                     F.col("p_brand"))
    author = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, " - Topic").otherwise(""))
    return p.select("p_partkey", form.alias("raw"), author.alias("author"), "p_brand", "p_name",
                    "p_type")


NOISY_CTE = "noisy AS (SELECT p_partkey, p_brand, p_name, CASE p_partkey % " + str(
    len(TITLE_FORMS)) + " " + " ".join(
    f"WHEN {i} THEN replace(replace('{f}', '{{t}}', p_name), '{{a}}', p_brand)"
    for i, f in enumerate(TITLE_FORMS)) + """ END AS raw,
  p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' - Topic' ELSE '' END AS author FROM part)"""


@query("i1_base_title", "WITH " + NOISY_CTE + f"""
SELECT p_partkey, {BASE_TITLE.format('raw')} AS base FROM noisy""")
def i1(spark, sf):
    return _noisy(spark, sf).select("p_partkey", X.base_title("raw").alias("base"))


CLEAN_TITLE_SQL = (r"trim(regexp_replace(regexp_replace(regexp_replace({0}, "
                   r"'[\(\[]\s*(?:official\s+music\s+video|official\s+audio|official\s+video|"
                   r"lyric\s+video|lyrics|visualizer|audio|video|hd|hq)\s*[\)\]]', '', 'gi'), "
                   r"'\bfeaturing\b', 'feat.', 'gi'), '\bft\.?\s+', 'feat. ', 'gi'))")
CLEAN_ARTIST_SQL = r"lower(trim(regexp_replace({0}, '\s*-\s*Topic$', '', 'i')))"


@query("i2_clean_title", "WITH " + NOISY_CTE + f"""
SELECT p_partkey, {CLEAN_TITLE_SQL.format('raw')} AS title FROM noisy""")
def i2(spark, sf):
    return _noisy(spark, sf).select("p_partkey", X.clean_title("raw").alias("title"))


@query("i3_clean_artist", "WITH " + NOISY_CTE + f"""
SELECT p_partkey, {CLEAN_ARTIST_SQL.format('author')} AS artist FROM noisy""")
def i3(spark, sf):
    return _noisy(spark, sf).select("p_partkey", X.clean_artist("author").alias("artist"))


MATCH_SQL = """coalesce({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})
  OR len(list_intersect(list_filter(string_split({a}, ' '), lambda w: length(w) >= 3),
                        list_filter(string_split({b}, ' '), lambda w: length(w) >= 3))) > 0), false)"""


@query("i4_artists_match", "WITH p AS (SELECT p_partkey, lower(p_name) AS a, "
       "CASE WHEN p_partkey % 9 = 0 THEN '' ELSE lower(lead(p_name) OVER (ORDER BY p_partkey)) END AS b "
       "FROM part) SELECT p_partkey, " + MATCH_SQL.format(a="a", b="b") + " AS m FROM p")
def i4(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = p.join(nxt, "p_partkey", "left").withColumn(
        "b", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("b")))
    return both.select("p_partkey", X.artists_match("a", "b").alias("m"))


NOISE_BLOCK_SQL = (r"trim(regexp_replace({0}, '\s*[\(\[](Official|Audio|Lyric|Music|HD|4K|"
                   r"Visualizer|Live|Remix|Explicit|Remaster)[^\)\]]*[\)\]]', '', 'gi'))")


@query("i5_parse_title", "WITH " + NOISY_CTE + f""", c AS (
  SELECT *, {NOISE_BLOCK_SQL.format('raw')} AS t,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE author END AS who FROM noisy)
SELECT p_partkey, CASE WHEN contains(t, ' - ') THEN trim(split_part(t, ' - ', 1))
    WHEN who = '' THEN 'Unknown' ELSE trim(who) END AS artist,
  CASE WHEN contains(t, ' - ') THEN trim(substr(t, instr(t, ' - ') + 3))
    WHEN t = '' THEN raw ELSE t END AS title FROM c""")
def i5(spark, sf):
    df = _noisy(spark, sf).withColumn(
        "who", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("author")))
    return df.withColumn("p", X.parse_title("raw", "who")).select(
        "p_partkey", F.col("p.artist").alias("artist"), F.col("p.title").alias("title"))


VIDEO_SUFFIX_SQL = (r"trim(regexp_replace({0}, '\s*\((?:official\s+(?:video|audio|music\s+video|"
                    r"lyric\s+video)|lyrics?|audio|hd|4k|official|visualizer|live|remix|explicit)\)',"
                    r" '', 'gi'))")


@query("i6_parse_video_title", "WITH " + NOISY_CTE + rf""", c AS (
  SELECT *, {VIDEO_SUFFIX_SQL.format('raw')} AS t,
    trim(regexp_replace(author, '\s*-\s*Topic$', '', 'i')) AS who FROM noisy)
SELECT p_partkey,
  CASE WHEN contains(t, ' - ') THEN trim(split_part(t, ' - ', 1))
    WHEN contains(t, ' | ') THEN trim(split_part(t, ' | ', 1))
    WHEN regexp_matches(t, '^(.+?)\s+by\s+(.+)$', 'i')
      THEN trim(regexp_extract(t, '^(.+?)\s+by\s+(.+)$', 2, 'i')) ELSE who END AS artist,
  CASE WHEN contains(t, ' - ') THEN trim(substr(t, instr(t, ' - ') + 3))
    WHEN contains(t, ' | ') THEN trim(substr(t, instr(t, ' | ') + 3))
    WHEN regexp_matches(t, '^(.+?)\s+by\s+(.+)$', 'i')
      THEN trim(regexp_extract(t, '^(.+?)\s+by\s+(.+)$', 1, 'i')) ELSE t END AS title FROM c""")
def i6(spark, sf):
    return _noisy(spark, sf).withColumn("p", X.parse_video_title("raw", "author")).select(
        "p_partkey", F.col("p.artist").alias("artist"), F.col("p.title").alias("title"))


@query("i7_parse_duration", """
SELECT l_orderkey, l_linenumber, l_quantity, CASE l_partkey % 5
  WHEN 0 THEN l_linenumber * 60 + l_quantity
  WHEN 1 THEN l_linenumber * 3600 + (l_suppkey % 60) * 60 + l_quantity END AS sec FROM lineitem""")
def i7(spark, sf):
    li = V.table(spark, sf, "lineitem")
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    form = F.col("l_partkey") % 5
    text = (F.when(form == 0, F.concat_ws(":", n, F.lpad(q, 2, "0")))
            .when(form == 1, F.concat_ws(":", n, (F.col("l_suppkey") % 60).cast("string"), q))
            .when(form == 2, "").when(form == 3, F.concat(q, F.lit(":xx"))).otherwise(q))
    return li.select("l_orderkey", F.col("l_linenumber"), "l_quantity",
                     X.parse_duration(text).alias("sec"))


@query("i8_release_year", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL
  ELSE year(o_orderdate) END::BIGINT AS year FROM orders""")
def i8(spark, sf):
    o, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    us = F.date_format(d, "MM/dd/yyyy hh:mm:ss a")
    recorded = F.when(o == 0, us).when(o == 1, F.date_format(d, "yyyy-MM-dd")).when(
        o == 4, "19/5/20").when(o == 5, "1/1/3008").otherwise(" ")
    created = F.when(o == 2, us).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", X.release_year(recorded, created).cast("long").alias("year"))


def _genre_literal(n):
    """A list-of-records literal; every ninth one is malformed."""
    one = lambda k: F.concat(
        F.lit("{'genre_id': '"), k.cast("string"), F.lit("', 'genre_title': "),
        F.when(k % 5 == 0, F.concat(F.lit('"Child\'s play '), k.cast("string"), F.lit('"')))
        .otherwise(F.concat(F.lit("'Genre "), k.cast("string"), F.lit("'"))),
        F.lit(", 'genre_url': 'http://x/'}"))
    body = F.concat(F.lit("["), one(n * 3), F.lit(", "), one(n), F.lit("]"))
    return F.when(n % 9 == 0, F.lit("[{'genre_title': 'Broken'")).otherwise(body)


GENRE_NAME_SQL = "CASE WHEN {k} % 5 = 0 THEN 'Child''s play ' || ({k}) ELSE 'Genre ' || ({k}) END"


@query("i9_genre_titles", f"""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE
  {GENRE_NAME_SQL.format(k='(p_partkey * 3)')} || '/' || {GENRE_NAME_SQL.format(k='p_partkey')}
  END AS titles FROM part""")
def i9(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", F.array_join(X.genre_titles(_genre_literal(F.col("p_partkey"))), "/").alias(
            "titles"))


TAGS = list(X.TAG_GENRES) + ["rock", "pop", "folk", "jazz", "classical"]


@query("i11_first_mapped_tag", "WITH m(tag, genre) AS (VALUES " + ", ".join(
    f"('{t}', '{g}')" for t, g in X.TAG_GENRES.items()) + f"), tags AS (SELECT {TAGS} AS names), "
    f"""e AS (SELECT p_partkey, i, names[(p_partkey * (2 * i + 1) + i) % {len(TAGS)} + 1] AS tag
  FROM part, tags, range(3) r(i))
SELECT p.p_partkey, min_by(m.genre, e.i) AS genre FROM part p
LEFT JOIN e USING (p_partkey) LEFT JOIN m ON m.tag = e.tag
GROUP BY p.p_partkey""")
def i11(spark, sf):
    n = F.col("p_partkey")
    names = F.array(*[F.lit(t) for t in TAGS])
    tags = F.array(*[F.get(names, ((n * (2 * i + 1) + i) % len(TAGS)).cast("int"))
                     for i in range(3)])
    return V.table(spark, sf, "part").select(
        n, X.first_mapped_tag(tags, X.TAG_GENRES).alias("genre"))


LABELS_CTE = "labels_(gid, label) AS (VALUES " + ", ".join(
    f"({g}, '{n}')" for g, n in X.GENRE_LABELS.items()) + ")"


@query("i12_genre_label", "WITH " + LABELS_CTE + """
SELECT p_partkey, coalesce(label, 'Electronic') AS genre FROM part
LEFT JOIN labels_ ON gid = p_partkey % 200""")
def i12(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", X.genre_label(F.col("p_partkey") % 200).alias("genre"))


@query("i13_album_genre", "WITH " + LABELS_CTE + """
SELECT p_partkey, coalesce(a.label, CASE WHEN p_partkey % 4 = 0 THEN NULL
  ELSE coalesce(b.label, CASE WHEN p_partkey % 3 > 0 THEN p_type END, c.label) END,
  'Electronic') AS genre
FROM part LEFT JOIN labels_ a ON a.gid = p_partkey % 200
LEFT JOIN labels_ b ON b.gid = p_size LEFT JOIN labels_ c ON c.gid = 98""")
def i13(spark, sf):
    n = F.col("p_partkey")
    listed = F.array(
        F.struct(F.col("p_size").cast("int").alias("id"),
                 F.when(n % 3 > 0, F.col("p_type")).otherwise("").alias("name")),
        F.struct(F.lit(98).alias("id"), F.lit("Reggae!").alias("name")))
    empty = F.filter(listed, lambda g: F.lit(False))
    return V.table(spark, sf, "part").select(
        n, X.album_genre(n % 200, F.when(n % 4 == 0, empty).otherwise(listed)).alias("genre"))


def _links(spark, sf):
    n = F.col("page_id")
    tag = F.substring(F.md5(n.cast("string")), 1, 11)
    num = n.cast("string")
    forms = (
        F.concat(F.lit("https://www.youtube.com/watch?v="), tag),
        F.concat(F.lit(" https://youtu.be/"), tag, F.lit("?t=3 ")),
        F.concat(F.lit("https://youtube.com.evil.example/watch?v="), tag),
        F.concat(F.lit("https://open.spotify.com/intl-de/track/"), tag, F.lit("?si=1")),
        F.concat(F.lit("https://soundcloud.com/dj-"), num, F.lit("/track_"), num),
        F.concat(F.lit("https://on.soundcloud.com/"), tag),
        F.concat(F.lit("https://music.apple.com/us/album/some-name/"), num, F.lit("?x=1&i=9"), num),
        F.concat(F.lit("https://music.apple.com/de/song/some-name/"), num),
        F.concat(F.lit("https://www.deezer.com/fr/track/"), num),
        F.concat(F.lit("https://link.deezer.com/s/"), tag),
    )
    url = F.col("url")
    for i, f in enumerate(forms):
        url = F.when(n % 12 == i, f).otherwise(url)
    return V.table(spark, sf, "pages").select("page_id", url.alias("url"))


LINKS_CTE = """links AS (SELECT page_id, substr(md5(page_id::VARCHAR), 1, 11) AS tag,
  CASE page_id % 12
    WHEN 0 THEN 'https://www.youtube.com/watch?v=' || tag WHEN 1 THEN ' https://youtu.be/' || tag || '?t=3 '
    WHEN 2 THEN 'https://youtube.com.evil.example/watch?v=' || tag
    WHEN 3 THEN 'https://open.spotify.com/intl-de/track/' || tag || '?si=1'
    WHEN 4 THEN 'https://soundcloud.com/dj-' || page_id || '/track_' || page_id
    WHEN 5 THEN 'https://on.soundcloud.com/' || tag
    WHEN 6 THEN 'https://music.apple.com/us/album/some-name/' || page_id || '?x=1&i=9' || page_id
    WHEN 7 THEN 'https://music.apple.com/de/song/some-name/' || page_id
    WHEN 8 THEN 'https://www.deezer.com/fr/track/' || page_id
    WHEN 9 THEN 'https://link.deezer.com/s/' || tag ELSE url END AS url FROM pages)"""


@query("i14_platform", "WITH " + LINKS_CTE + r"""
SELECT page_id, CASE WHEN regexp_matches(url, 'youtube\.com|youtu\.be') THEN 'youtube'
  WHEN regexp_matches(url, 'soundcloud\.com') THEN 'soundcloud'
  WHEN regexp_matches(url, 'open\.spotify\.com/track') THEN 'spotify'
  WHEN regexp_matches(url, 'music\.apple\.com/.+/(album|song)') THEN 'apple_music'
  WHEN regexp_matches(url, 'deezer\.com') THEN 'deezer' END AS platform FROM links""")
def i14(spark, sf):
    return _links(spark, sf).select("page_id", LK.detect_platform("url").alias("platform"))


@query("i15_link_ids", "WITH " + LINKS_CTE + """
SELECT page_id,
  CASE WHEN page_id % 12 IN (0, 1) THEN tag END AS video,
  CASE WHEN page_id % 12 = 3 THEN tag END AS spotify,
  CASE page_id % 12 WHEN 4 THEN 'dj-' || page_id || '/track_' || page_id WHEN 5 THEN 'short' END
    AS soundcloud,
  CASE page_id % 12 WHEN 6 THEN '9' || page_id WHEN 7 THEN page_id::VARCHAR END AS apple,
  CASE page_id % 12 WHEN 8 THEN page_id::VARCHAR WHEN 9 THEN 'share' END AS deezer FROM links""")
def i15(spark, sf):
    return _links(spark, sf).select(
        "page_id", LK.video_id("url").alias("video"), LK.spotify_id("url").alias("spotify"),
        LK.soundcloud_id("url").alias("soundcloud"), LK.apple_id("url").alias("apple"),
        LK.deezer_id("url").alias("deezer"))


@query("i16_host_allowed", r"""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)
SELECT page_id, host, host = 'example.com' OR ends_with(host, '.example.com')
  OR host = 'example.org' OR ends_with(host, '.example.org') AS ok FROM h""")
def i16(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", F.coalesce(LK.url_host("url"), F.lit("")).alias("host"),
        LK.host_allowed("url", ("example.com", "example.org")).alias("ok"))


@query("i17_camelot", "WITH " + CAMELOT_CTE + """
SELECT id, code FROM songs LEFT JOIN wheel ON k = musical_key""")
def i17(spark, sf):
    return V.vectors(spark, sf).select("id", H.camelot("musical_key").alias("code"))


@query("i18_harmonic_compatibility", "WITH " + CAMELOT_CTE + f"""
SELECT a.id, {compat_sql('wa.code', 'wb.code')} AS compat {PAIRS}
LEFT JOIN wheel wa ON wa.k = a.musical_key LEFT JOIN wheel wb ON wb.k = b.musical_key""")
def i18(spark, sf):
    return song_pairs(spark, sf).select("id", H.harmonic_compatibility(
        "a_musical_key", "b_musical_key").alias("compat"))


@query("i19_bpm_match", f"SELECT a.id, {bpm_sql('a.bpm', 'b.bpm')} AS m {PAIRS}")
def i19(spark, sf):
    return song_pairs(spark, sf).select("id", H.bpm_match("a_bpm", "b_bpm").alias("m"))


@query("i20_bpm_difference", f"""
SELECT a.id, floor(b.bpm / 1.3 - a.bpm + 0.5)::BIGINT AS d {PAIRS}""")
def i20(spark, sf):
    return song_pairs(spark, sf).select("id", H.bpm_difference(
        "a_bpm", F.col("b_bpm") / 1.3).alias("d"))


@query("i21_pseudonym", "SELECT id, substr(sha256(ip), 1, 16) AS h FROM feedback")
def i21(spark, sf):
    return V.feedback(spark, sf).select("id", X.pseudonym("ip").alias("h"))


@query("i22_minutes_seconds", """
SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE
  (floor(value * 10)::BIGINT // 60) || ':' || lpad((floor(value * 10)::BIGINT % 60)::VARCHAR, 2, '0')
  END AS t FROM events""")
def i22(spark, sf):
    sec = F.when(F.col("event_type") != "view", F.col("value") * 10)
    return V.table(spark, sf, "events").select("event_id", H.minutes_seconds(sec).alias("t"))


def _nested(spark, sf):
    """Response-shaped rows: the entries of a playlist as credits, releases and results."""
    w = F.sort_array(F.collect_list(F.struct("position", "artist", "title", "bpm", "song_id")))
    rows = V.playlists(spark, sf).groupBy("playlist_id").agg(w.alias("e"))
    return rows.select(
        "playlist_id",
        F.transform("e", lambda x: F.struct(
            F.when(x["position"] % 4 != 0, x["artist"]).otherwise("").alias("name"),
            F.when(x["position"] < F.size("e"), " & ").alias("joinphrase"))).alias("credits"),
        F.filter(F.transform("e", lambda x: F.struct(x["title"].alias("title"))),
                 lambda x: F.size("e") > 2).alias("releases"),
        F.transform("e", lambda x: F.struct(F.filter(
            F.array(F.struct(x["song_id"].cast("string").alias("id"))),
            lambda r: x["bpm"] > 100).alias("recordings"))).alias("results"))


@query("i23_artist_credit", """
SELECT playlist_id, coalesce(trim(string_agg(artist || CASE WHEN position < n THEN ' & ' ELSE '' END, ''
    ORDER BY position) FILTER (position % 4 <> 0)), '') AS credit,
  CASE WHEN max(n) > 2 THEN min_by(title, position) ELSE '' END AS album
FROM (SELECT *, count(*) OVER (PARTITION BY playlist_id) AS n FROM playlists) GROUP BY playlist_id""")
def i23(spark, sf):
    return _nested(spark, sf).select("playlist_id", X.artist_credit("credits").alias("credit"),
                                     X.first_release("releases").alias("album"))


@query("i24_first_recording", """
SELECT playlist_id, (min_by(song_id, position) FILTER (bpm > 100))::VARCHAR AS recording
FROM playlists GROUP BY playlist_id""")
def i24(spark, sf):
    return _nested(spark, sf).select("playlist_id", X.first_recording("results").alias("recording"))


LINE_SQL = """position || '. ' || artist || ' — ' || title ||
  CASE WHEN coalesce(bpm, 0) <> 0 THEN ' | ' || floor(bpm + 0.5)::BIGINT || ' BPM' ELSE '' END ||
  CASE WHEN coalesce(musical_key, '') <> '' THEN ' | ' || musical_key ELSE '' END"""


@query("i25_playlist_text", f"""
SELECT playlist_id, ((position - 1) // 500)::BIGINT AS chunk, string_agg({LINE_SQL}, chr(10) ORDER BY position) AS text
FROM playlists GROUP BY ALL""")
def i25(spark, sf):
    return PL.playlist_text(V.playlists(spark, sf))


@query("g6_playlist_flow", """
WITH b AS (SELECT *, coalesce(bpm, 0) AS t, greatest(max(coalesce(bpm, 0)) OVER w, 1) AS hi,
    min(bpm) FILTER (bpm > 0) OVER w AS lo0, count(*) OVER w AS n
  FROM playlists WINDOW w AS (PARTITION BY playlist_id)),
c AS (SELECT *, least(coalesce(lo0, hi), hi) AS lo FROM b)
SELECT playlist_id, position, t AS bpm, intensity, lo AS min_bpm, hi::DOUBLE AS max_bpm,
  round(CASE WHEN n > 1 THEN (position - 1) / (n - 1) ELSE 0 END, 6) AS x,
  round((t - lo) / greatest(hi - lo, 10), 6) AS bpm_level FROM c""")
def g6(spark, sf):
    return PL.playlist_flow(V.playlists(spark, sf)).select(
        "playlist_id", F.col("position").cast("long").alias("position"), "bpm", "intensity", "min_bpm",
        "max_bpm", F.round("x", 6).alias("x"), F.round("bpm_level", 6).alias("bpm_level"))


@query("g4_recent_per_session", """
SELECT session_hash, id, n FROM (SELECT *, row_number() OVER (
    PARTITION BY session_hash ORDER BY created_at DESC, id DESC) AS n FROM clicks) WHERE n <= 20""")
def g4(spark, sf):
    return PL.recent_per_session(V.clicks(spark, sf)).select(
        "session_hash", "id", F.col("n").cast("long").alias("n"))


@query("l_sql_functions", "WITH " + CAMELOT_CTE + f"""
SELECT a.id, round(list_cosine_similarity(a.learned, b.learned), 6) AS cosine,
  {BASE_TITLE.format('a.title')} AS base, code {PAIRS} LEFT JOIN wheel ON k = a.musical_key""")
def l_sql(spark, sf):
    SQL.register(spark)
    a, b = V.songs(spark, sf), V.songs(spark, sf)
    return spark.sql("""
        SELECT a.id, round(cosine_similarity(a.learned, b.learned), 6) AS cosine,
          base_title(a.title) AS base, camelot(a.musical_key) AS code
        FROM {a} a JOIN {b} b ON b.id = a.id + 1""", a=a, b=b)


@query("l_find_similar_songs", """
WITH q AS (SELECT id, learned FROM songs WHERE id = (SELECT min(id) FROM songs)),
pairs AS (SELECT s.id, s.title, s.bpm, round(list_cosine_similarity(s.learned, q.learned), 12) AS similarity
  FROM songs s, q WHERE s.id <> q.id AND s.bpm BETWEEN 60 AND 160 AND s.metadata_status <> 'failed')
SELECT id, title, bpm, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank
FROM pairs QUALIFY rank <= 25""")
def l_find(spark, sf):
    V.songs(spark, sf).createOrReplaceTempView("songs")
    SQL.register_search(spark)
    return spark.sql("""
        SELECT id, title, bpm, round(similarity, 6) AS similarity, rank
        FROM find_similar_songs((SELECT min_by(learned, id) FROM songs), 25, (SELECT min(id) FROM songs), 60, 160)""")


GRAMS_SQL = r"""list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'),
    lambda w: list_transform(generate_series(1, len(w) + 1), lambda i: substring('  ' || w || ' ', i, 3)))))"""


@query("f9_similar_names", "WITH n AS (SELECT DISTINCT lower(title) AS needle FROM songs WHERE title IS NOT NULL), "
       "h AS (SELECT DISTINCT title || ' ' || coalesce(artist, '') AS hay FROM songs WHERE title IS NOT NULL), "
       "a AS (SELECT needle, " + GRAMS_SQL.format(c="needle") + " AS g FROM n), "
       "b AS (SELECT hay, " + GRAMS_SQL.format(c="hay") + """ AS g FROM h),
p AS (SELECT needle, hay, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS total FROM a, b)
SELECT needle, hay, shared, round(shared / (total - shared), 6) AS similarity FROM p
WHERE shared > 0 AND 100 * shared >= 50 * (total - shared)""")
def f9_names(spark, sf):
    """Titles against the full names of songs, half of the trigrams in common."""
    songs = V.songs(spark, sf).where("title IS NOT NULL")
    full = F.concat("title", F.lit(" "), F.coalesce("artist", F.lit("")))
    found = names.similar_names(songs.select(F.lower("title").alias("needle")), songs.select(full.alias("hay")))
    return found.withColumn("similarity", F.round("similarity", 6))
