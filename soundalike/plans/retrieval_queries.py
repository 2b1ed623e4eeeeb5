"""Registered queries of vector retrieval and re-ranking (D, E21, parts of G and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundalike.functions import layout as L
from soundalike.functions.harmonic import CAMELOT
from soundalike.operators import feedback as FB
from soundalike.operators import rank as R
from soundalike.operators import results as RS
from soundalike.operators import search as S
from soundalike.plans import recommend as P
from soundalike.plans.registry import query
from soundalike.sources import views as V

ANY = -1.0  # similarity floor that keeps whole lists


def self_queries(songs):
    """Every song of the catalogue as a query."""
    return songs.select(F.col("id").alias("query_id"), F.col("learned").alias("vector"),
                        F.col("handcrafted_norm").alias("handcrafted"), "mert", "genre")


def shown(df, *extra):
    return df.select("query_id", "id", F.round("similarity", 6).alias("similarity"),
                     F.col("rank").cast("long").alias("rank"), *extra)


def pool_sql(k: int, factor: int = 5, name: str = "cand") -> str:
    """Live search semantics for every song: a pool of ``factor * k``, then the filters."""
    return f"""pairs AS (
      SELECT a.id AS query_id, b.id, b.bpm,
        round(list_cosine_similarity(a.learned, b.learned), 12) AS similarity
      FROM songs a CROSS JOIN songs b),
    pool AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pr
      FROM pairs),
    kept AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
      FROM pool WHERE pr <= {k * factor} AND id <> query_id AND bpm BETWEEN 0 AND 999),
    {name} AS (SELECT query_id, id, similarity, rank FROM kept WHERE rank <= {k})"""


FINAL = "SELECT query_id, id, round(similarity, 6) AS similarity, rank::BIGINT AS rank FROM "


@query("d1_top_k", "WITH " + pool_sql(20) + FINAL + "cand")
def d1(spark, sf):
    songs = V.vectors(spark, sf)
    return shown(S.top_k(self_queries(songs), songs, 20, exclude="query_id"))


@query("d2_top_k_prefilter", """
WITH pairs AS (
  SELECT a.id AS query_id, b.id,
    round(list_cosine_similarity(a.learned, b.learned), 12) AS similarity
  FROM songs a CROSS JOIN songs b
  WHERE b.id <> a.id AND b.bpm BETWEEN 80 AND 160 AND b.metadata_status <> 'failed'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
      FROM pairs)
""" + FINAL + "r WHERE rank <= 20")
def d2(spark, sf):
    songs = V.vectors(spark, sf)
    return shown(S.top_k(self_queries(songs), songs, 20, exclude="query_id",
                         min_bpm=80, max_bpm=160, filter_mode="pre"))


WEIGHTS_CTE = """votes AS (
  SELECT s.genre, f.focus_active AS focus_category, count(*) AS votes
  FROM feedback f JOIN songs s ON s.id = f.query_song_id
  WHERE f.focus_active IS NOT NULL AND f.rating = 1 AND s.genre IS NOT NULL
  GROUP BY ALL),
weights AS (
  SELECT genre, focus_category, votes AS vote_count,
    round(votes::DOUBLE / sum(votes) OVER (PARTITION BY genre), 4) AS weight
  FROM votes QUALIFY sum(votes) OVER (PARTITION BY genre) >= 20),
wide AS (
  SELECT genre, sum(weight) AS total, """ + ", ".join(
    f"coalesce(max(weight) FILTER (focus_category = '{c}'), 0.2) AS w_{c}" for c in L.FOCUS) + """
  FROM weights GROUP BY genre)"""


def slice_sql(v: str, dims) -> str:
    dims = list(dims)
    if dims == list(range(dims[0], dims[-1] + 1)):
        return f"{v}[{dims[0] + 1}:{dims[-1] + 1}]"
    return "[" + ", ".join(f"{v}[{d + 1}]" for d in dims) + "]"


def category_cosine(c: str, q: str, r: str) -> str:
    return f"list_cosine_similarity({slice_sql(q, L.FOCUS[c])}, {slice_sql(r, L.FOCUS[c])})"


def fused_sql(focus: str | None, weighted: bool, source: str = "cand", name: str = "fused") -> str:
    q, r = "q.handcrafted_norm", "s.handcrafted_norm"
    whole = f"list_cosine_similarity({q}, {r})"
    if focus:
        hc, w = category_cosine(focus, q, r), ("0.55, 0.15, 0.30", "0.60, 0.0, 0.40")
        shares = f"CASE WHEN m THEN [{w[0]}]::DOUBLE[] ELSE [{w[1]}]::DOUBLE[] END"
    elif weighted:
        total = " + ".join(f"w_{c}" for c in L.FOCUS)
        mixed = " + ".join(f"w_{c} / ({total}) * {category_cosine(c, q, r)}" for c in L.FOCUS)
        hc = f"CASE WHEN total IS NULL THEN {whole} ELSE {mixed} END"
        shares = """CASE WHEN total IS NULL THEN
            CASE WHEN m THEN [0.65, 0.15, 0.20]::DOUBLE[] ELSE [0.80, 0.0, 0.20]::DOUBLE[] END
          WHEN m THEN [0.70 - 0.15 * least(1.0, 2 * total), 0.15,
                       0.15 + 0.15 * least(1.0, 2 * total)]::DOUBLE[]
          ELSE [0.8 - 0.2 * least(1.0, 2 * total), 0.0,
                0.2 + 0.2 * least(1.0, 2 * total)]::DOUBLE[] END"""
    else:
        hc = whole
        shares = "CASE WHEN m THEN [0.65, 0.15, 0.20]::DOUBLE[] ELSE [0.80, 0.0, 0.20]::DOUBLE[] END"
    join = "LEFT JOIN wide ON wide.genre = q.genre" if weighted else ""
    totals = "total" if weighted else "NULL AS total"
    return f"""{name}_in AS (
      SELECT c.query_id, c.id, c.rank, c.similarity, s.title, s.artist, s.learned,
        q.mert IS NOT NULL AND bool_or(s.mert IS NOT NULL) OVER (PARTITION BY c.query_id) AS m,
        {hc} AS hc_sim,
        coalesce(list_cosine_similarity(q.mert, s.mert), 0.0) AS mert_sim, {totals}
      FROM {source} c JOIN songs q ON q.id = c.query_id JOIN songs s ON s.id = c.id {join}),
    {name}_w AS (SELECT *, {shares} AS w FROM {name}_in),
    {name} AS (
      SELECT query_id, id, title, artist, learned, round(score, 12) AS similarity,
        row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rank, id) AS rank
      FROM (SELECT *, w[1] * similarity + w[2] * mert_sim + w[3] * hc_sim AS score
            FROM {name}_w))"""


def genre_weights(spark, sf, songs):
    return FB.genre_focus_weights(V.feedback(spark, sf), songs)


@query("d3_fusion_weights", "WITH " + WEIGHTS_CTE + """
SELECT s.id, m.has_mert, round(CASE WHEN total IS NULL THEN CASE WHEN has_mert THEN 0.65 ELSE 0.8 END
    WHEN has_mert THEN 0.70 - 0.15 * least(1.0, 2 * total) ELSE 0.8 - 0.2 * least(1.0, 2 * total) END,
    6) AS learned,
  CASE WHEN has_mert THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS mert,
  round(CASE WHEN total IS NULL THEN 0.2 WHEN has_mert THEN 0.15 + 0.15 * least(1.0, 2 * total)
    ELSE 0.2 + 0.2 * least(1.0, 2 * total) END, 6) AS handcrafted
FROM songs s CROSS JOIN (VALUES (true), (false)) m(has_mert)
LEFT JOIN wide ON wide.genre = s.genre""")
def d3(spark, sf):
    songs = V.vectors(spark, sf)
    maps = R.weight_maps(genre_weights(spark, sf, songs))
    both = songs.select("id", "genre", F.explode(F.array(F.lit(True), F.lit(False))).alias(
        "has_mert")).join(maps, "genre", "left")
    w = R.fusion_weights(F.lit(None).cast("string"), F.col("has_mert"), F.col("weights"))
    return both.withColumn("w", w).select(
        "id", "has_mert", F.round("w.learned", 6).alias("learned"),
        F.round("w.mert", 6).alias("mert"), F.round("w.handcrafted", 6).alias("handcrafted"))


def _candidates(songs, k=60):
    q = self_queries(songs)
    return q, S.top_k(q, songs, k, exclude="query_id")


@query("d4_late_fusion", "WITH " + WEIGHTS_CTE + ", " + pool_sql(60) + ", "
       + fused_sql(None, True) + FINAL + "fused")
def d4(spark, sf):
    songs = V.vectors(spark, sf)
    q, cand = _candidates(songs)
    return shown(R.fuse(cand, q, songs, genre_weights(spark, sf, songs)))


@query("d4_late_fusion_plain", "WITH " + pool_sql(60) + ", " + fused_sql(None, False)
       + FINAL + "fused")
def d4_plain(spark, sf):
    songs = V.vectors(spark, sf)
    q, cand = _candidates(songs)
    return shown(R.fuse(cand, q, songs))


def _focused(focus):
    def run(spark, sf):
        songs = V.vectors(spark, sf)
        q, cand = _candidates(songs)
        return shown(R.fuse(cand, q, songs, focus=focus))
    return run


for _focus in L.FOCUS:
    query(f"d4_late_fusion_{_focus}", "WITH " + pool_sql(60) + ", " + fused_sql(_focus, False)
          + FINAL + "fused")(_focused(_focus))


BASE_TITLE = (r"lower(trim(regexp_replace(regexp_replace({0}, '\s*[\(\[].*?[\)\]]\s*', '', 'g'), "
              r"'\s*[-–—]\s*(?:radio edit|extended|remix|original mix|club mix|dub mix|"
              r"instrumental|acoustic|live|remaster(?:ed)?|slowed|sped up|mix cut|mixed|"
              r"feat\..*|ft\..*)$', '', 'gi')))")


def dedup_sql(source: str, name: str = "deduped") -> str:
    return f"""{name} AS (
      SELECT query_id, id, similarity, learned,
        row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id,
                lower(artist) || '||' || {BASE_TITLE.format('title')} ORDER BY rank) AS n
            FROM {source}) WHERE n = 1)"""


@query("d5_version_dedup", "WITH " + pool_sql(60) + ", " + fused_sql(None, False) + ", "
       + dedup_sql("fused") + FINAL + "deduped")
def d5(spark, sf):
    songs = V.songs(spark, sf)
    q, cand = _candidates(songs)
    fused = R.fuse(cand, q, R.with_version_key(songs), carry=("version_key",))
    return shown(R.dedup_versions(fused))


def mmr_sql(source: str, limit: int, lam: float = 0.7, name: str = "diverse") -> str:
    order = f"""(sel IS NULL) DESC,
        round({lam} * similarity - {round(1 - lam, 6)} * pen, 12) DESC, rank"""
    return f"""start AS (
      SELECT d.query_id, d.id, d.similarity, d.rank, d.learned, 1 AS step,
        CASE WHEN d.rank = 1 THEN 1 END AS sel,
        list_cosine_similarity(d.learned, f.learned) AS pen,
        count(*) OVER (PARTITION BY d.query_id) AS n
      FROM {source} d JOIN {source} f ON f.query_id = d.query_id AND f.rank = 1),
    walk AS (
      SELECT * FROM start
      UNION ALL
      SELECT query_id, id, similarity, rank, learned, step + 1,
        CASE WHEN sel IS NOT NULL THEN sel WHEN rn = 1 THEN step + 1 END,
        greatest(pen, list_cosine_similarity(learned, picked)), n
      FROM (SELECT *,
              first_value(learned) OVER (PARTITION BY query_id ORDER BY {order}) AS picked,
              row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rn
            FROM walk WHERE step < {limit})),
    {name} AS (
      SELECT query_id, id, similarity, CASE WHEN n > {limit} THEN sel ELSE rank END AS rank
      FROM walk WHERE step = {limit} AND (sel IS NOT NULL OR n <= {limit}))"""


@query("d6_mmr", "WITH RECURSIVE " + pool_sql(60, name="cand0") + ", "
       "cand AS (SELECT c.*, s.learned FROM cand0 c JOIN songs s ON s.id = c.id), "
       + mmr_sql("cand", 20) + FINAL + "diverse")
def d6(spark, sf):
    songs = V.vectors(spark, sf)
    _, cand = _candidates(songs)
    return shown(R.mmr(cand, 20, songs=songs))


@query("d7_similar", "WITH RECURSIVE " + WEIGHTS_CTE + ", " + pool_sql(60) + ", "
       + fused_sql(None, True) + ", " + dedup_sql("fused") + ", " + mmr_sql("deduped", 20)
       + FINAL + "diverse WHERE similarity >= 0.1")
def d7(spark, sf):
    songs = V.songs(spark, sf)
    asked = songs.select(F.col("id").alias("query_id"), F.col("id").alias("song_id"))
    return shown(P.similar(asked, songs, 20, genre_weights=genre_weights(spark, sf, songs),
                           min_sim=0.1))


@query("d7_similar_focus_excluding", """
WITH RECURSIVE pairs AS (
  SELECT a.id AS query_id, b.id, b.bpm,
    round(list_cosine_similarity(a.learned, b.learned), 12) AS similarity
  FROM songs a CROSS JOIN songs b),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pr
         FROM pairs),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
         FROM pool WHERE pr <= 32 * 5 AND id <> query_id AND bpm BETWEEN 0 AND 999),
cand AS (SELECT * FROM kept WHERE rank <= 32 AND id NOT IN (query_id + 1, query_id + 2)), """
       + fused_sql("rhythm", False) + ", " + dedup_sql("fused") + ", " + mmr_sql("deduped", 10)
       + FINAL + "diverse WHERE similarity >= 0.1")
def d7_excluding(spark, sf):
    songs = V.songs(spark, sf)
    asked = songs.select(F.col("id").alias("query_id"), F.col("id").alias("song_id"),
                         F.array(F.col("id") + 1, F.col("id") + 2).alias("exclude_ids"))
    return shown(P.similar(asked, songs, 10, focus="rhythm", min_sim=0.1))


@query("b8_min_similarity", "WITH " + pool_sql(20) + FINAL + "cand WHERE similarity >= 0.3")
def b8(spark, sf):
    _, cand = _candidates(V.vectors(spark, sf), 20)
    return shown(R.min_similarity(cand))


@query("d8_blend", """
WITH asked AS (
  SELECT a.id AS query_id, a.id AS song_a, b.id AS song_b,
    list_transform(list_zip(a.learned, b.learned), lambda p: (p[1] + p[2]) / 2) AS v,
    list_transform(list_zip(a.handcrafted_norm, b.handcrafted_norm),
                   lambda p: (p[1] + p[2]) / 2) AS hc
  FROM songs a JOIN songs b ON b.id = a.id + 1),
pairs AS (SELECT query_id, song_a, song_b, hc, s.id, s.bpm, s.title, s.artist, s.learned,
    s.handcrafted_norm, round(list_cosine_similarity(v, s.learned), 12) AS similarity
  FROM asked CROSS JOIN songs s),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pr
  FROM pairs),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM pool WHERE pr <= 62 * 5 AND bpm BETWEEN 0 AND 999),
scored AS (SELECT query_id, id, title, artist, learned, rank AS old,
    round(0.8 * similarity + 0.2 * list_cosine_similarity(hc, handcrafted_norm), 12) AS similarity
  FROM kept WHERE rank <= 62 AND id <> song_a AND id <> song_b),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, old, id) AS rank
  FROM scored), """ + dedup_sql("fused") + FINAL + "deduped WHERE rank <= 20")
def d8(spark, sf):
    songs = V.songs(spark, sf)
    nxt = songs.select((F.col("id") - 1).alias("query_id"), F.col("id").alias("song_b"))
    pairs = songs.select(F.col("id").alias("query_id"), F.col("id").alias("song_a")).join(
        nxt, "query_id")
    return shown(P.blend(pairs, songs, 20, min_sim=ANY))


def _seed_sets(songs):
    """Sets of three neighbouring ids that all exist."""
    # Each id votes for the sets that it is in: one shuffle of ids, and none of them is broadcast.
    n = F.col("id")
    spots = songs.where(n.isNotNull()).select(
        F.explode(F.array(*[F.struct((n - i).alias("query_id"), F.lit(i).alias("at")) for i in range(3)])).alias("s"))
    votes = spots.groupBy("s.query_id").agg(*[F.count(F.when(F.col("s.at") == i, 1)).alias(f"n{i}") for i in range(3)])
    return (votes.where("n0 > 0 AND n1 > 0 AND n2 > 0")
            .select("query_id", F.explode(F.array_repeat("query_id", F.col("n0").cast("int"))))
            .select("query_id", F.array(F.col("query_id"), F.col("query_id") + 1,
                                        F.col("query_id") + 2).alias("song_ids")))


LISTS_SQL = """pairs AS (
  SELECT a.id AS query_id, b.id, b.bpm,
    round(list_cosine_similarity(a.learned, b.learned), 12) AS similarity
  FROM songs a CROSS JOIN songs b),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pr
  FROM pairs),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM pool WHERE pr <= {k} * 5 AND bpm BETWEEN 0 AND 999),
sets AS (SELECT id AS query_id FROM songs a WHERE
  EXISTS (SELECT 1 FROM songs b WHERE b.id = a.id + 1) AND
  EXISTS (SELECT 1 FROM songs b WHERE b.id = a.id + 2)),
lists AS (SELECT s.query_id, k.query_id - s.query_id AS pos, k.id, k.similarity, k.rank
  FROM sets s JOIN kept k ON k.query_id BETWEEN s.query_id AND s.query_id + 2
  WHERE k.rank <= {k} AND k.id NOT BETWEEN s.query_id AND s.query_id + 2),
common AS (SELECT query_id, id, min(similarity) AS similarity, min(pos * 1000 + rank) AS first
  FROM lists GROUP BY ALL HAVING count(*) >= 2)"""


@query("d9_vibe", "WITH " + LISTS_SQL.format(k=100) + """,
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, first, id) AS rank
  FROM common),
centres AS (SELECT query_id, list(x ORDER BY i) AS v FROM (
  SELECT query_id, i, avg(x) AS x FROM (
    SELECT t.query_id, unnest(s.learned) AS x, unnest(range(len(s.learned))) AS i
    FROM sets t JOIN songs s ON s.id BETWEEN t.query_id AND t.query_id + 2) GROUP BY ALL)
  GROUP BY query_id),
cp AS (SELECT query_id, s.id, s.bpm, round(list_cosine_similarity(v, s.learned), 12) AS similarity
  FROM centres CROSS JOIN songs s),
cpool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pr
  FROM cp),
ckept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM cpool WHERE pr <= 23 * 5 AND bpm BETWEEN 0 AND 999),
merged AS (
  SELECT query_id, id, similarity, 0 AS tier, rank FROM c
  UNION ALL
  SELECT query_id, id, similarity, 1, rank FROM ckept k
  WHERE rank <= 23 AND id NOT BETWEEN query_id AND query_id + 2
    AND NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = k.query_id AND c.id = k.id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, id) AS r
  FROM merged),
named AS (SELECT m.query_id, m.id, m.similarity, r AS rank, s.title, s.artist, s.learned
  FROM ranked m JOIN songs s ON s.id = m.id WHERE tier = 0 OR r <= 20), """
       + dedup_sql("named") + FINAL + "deduped WHERE rank <= 20")
def d9(spark, sf):
    songs = V.songs(spark, sf)
    return shown(P.vibe(_seed_sets(songs), songs, 20, per_seed=100, min_sim=ANY))


@query("h1_common_of_lists", "WITH " + LISTS_SQL.format(k=100) + """
SELECT query_id, id, round(similarity, 6) AS similarity FROM common""")
def h1(spark, sf):
    songs = V.vectors(spark, sf)
    seeds = _seed_sets(songs).select("query_id", "song_ids",
                                     F.posexplode("song_ids").alias("pos", "song_id"))
    lists = S.top_k(self_queries(songs), songs, 100).withColumnRenamed("query_id", "song_id")
    joined = (seeds.join(lists, "song_id").where(~F.array_contains("song_ids", F.col("id")))
              .withColumn("needed", F.lit(2)))
    return P.intersect_lists(joined).select(
        "query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("h2_append_missing", "WITH " + pool_sql(12, name="wide_list") + """,
first AS (SELECT * FROM wide_list WHERE similarity >= 0.3),
m AS (SELECT *, 0 AS tier FROM first UNION ALL SELECT *, 1 FROM wide_list w
  WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.query_id = w.query_id AND f.id = w.id)),
r AS (SELECT query_id, id, similarity, tier,
  row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, id) AS rank FROM m)
""" + FINAL + "r WHERE tier = 0 OR rank <= 8")
def h2(spark, sf):
    _, cand = _candidates(V.vectors(spark, sf), 12)
    return shown(P.append_missing(R.min_similarity(cand), cand, 8))


@query("d10_nearest_for_new", """
WITH fresh AS (SELECT * FROM songs WHERE created_at >= TIMESTAMP '2024-01-02'),
pairs AS (
  SELECT a.id AS query_id, b.id, b.bpm,
    round(list_cosine_similarity(a.learned, b.learned), 12) AS similarity
  FROM fresh a CROSS JOIN songs b),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS pr
  FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM pool WHERE pr <= 100 AND id <> query_id AND bpm BETWEEN 0 AND 999)
""" + FINAL + "r WHERE rank <= 20")
def d10(spark, sf):
    songs = V.vectors(spark, sf)
    fresh = songs.where(F.col("created_at") >= F.lit("2024-01-02").cast("timestamp"))
    return shown(S.nearest_for_new(fresh, songs))


def step_sql(prev: str, step: int, limit: int = 5) -> str:
    """The next song of every walk: the best fused candidate that was not visited."""
    k, t = limit * 3 + step, f"t{step}"
    return f"""{t}p AS (
      SELECT w.journey_id, w.visited, w.song_id, q.mert AS q_mert, q.handcrafted_norm AS q_hc,
        b.id, b.bpm, b.mert, b.handcrafted_norm,
        round(list_cosine_similarity(q.learned, b.learned), 12) AS similarity
      FROM {prev} w JOIN songs q ON q.id = w.song_id CROSS JOIN songs b),
    {t}pool AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY similarity DESC, id) AS pr
      FROM {t}p),
    {t}kept AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY similarity DESC, id) AS rank
      FROM {t}pool WHERE pr <= {k * 5} AND id <> song_id AND bpm BETWEEN 0 AND 999),
    {t}c AS (SELECT *, q_mert IS NOT NULL AND bool_or(mert IS NOT NULL) OVER (PARTITION BY journey_id) AS m,
        list_cosine_similarity(q_hc, handcrafted_norm) AS hc,
        coalesce(list_cosine_similarity(q_mert, mert), 0) AS ms
      FROM {t}kept WHERE rank <= {k} AND NOT list_contains(visited, id)),
    {t}s AS (SELECT *, round(CASE WHEN m THEN 0.65 * similarity + 0.15 * ms + 0.2 * hc
        ELSE 0.8 * similarity + 0.2 * hc END, 12) AS score FROM {t}c),
    {t} AS (SELECT journey_id, id AS song_id, score, list_append(visited, id) AS visited FROM {t}s
      QUALIFY row_number() OVER (PARTITION BY journey_id ORDER BY score DESC, rank, id) = 1
        AND score >= 0.1)"""


WALK = 5


@query("d11_journeys", "WITH t0 AS (SELECT id AS journey_id, id AS song_id, 0 AS score, [id] AS visited FROM songs), "
       + ", ".join(step_sql(f"t{i}", i + 1) for i in range(WALK)) + """
SELECT journey_id, count(*) AS steps, round(sum(1 - score), 6) AS distance, count(DISTINCT genre) AS genres
FROM (""" + " UNION ALL ".join(f"SELECT journey_id, song_id, score FROM t{i}" for i in range(WALK + 1)) + """)
JOIN songs ON id = song_id GROUP BY journey_id""")
def d11(spark, sf):
    songs = V.songs(spark, sf)
    starts = songs.select(F.col("id").alias("journey_id"), F.col("id").alias("song_id"))
    path = P.journeys(starts, songs, WALK, min_sim=0.1)
    return P.journey_stats(path, songs).select(
        "journey_id", "steps", F.round("distance", 6).alias("distance"), "genres")


CAMELOT_CTE = "wheel(k, code) AS (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in CAMELOT.items()) + ")"
COMPAT_CASE = """CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL
  WHEN right({a}, 1) = right({b}, 1) AND {d} <= 1 THEN 'perfect'
  WHEN (right({a}, 1) = right({b}, 1) AND {d} = 2)
    OR (right({a}, 1) <> right({b}, 1) AND {d} = 0) THEN 'compatible'
  ELSE 'incompatible' END"""


def compat_sql(a: str, b: str) -> str:
    na, nb = f"{a}[:-2]::INT", f"{b}[:-2]::INT"
    d = f"least(abs({na} - {nb}), 12 - abs({na} - {nb}))"
    return COMPAT_CASE.format(a=a, b=b, d=d)


def bpm_sql(a: str, b: str) -> str:
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = 0 OR {b} = 0 THEN NULL
      WHEN abs({a} - {b}) / greatest({a}, {b}) <= 0.02 THEN 'exact'
      WHEN abs({a} - {b}) / greatest({a}, {b}) <= 0.05 THEN 'close' ELSE 'far' END"""


@query("d12_harmonic_mix", "WITH " + CAMELOT_CTE + ", " + pool_sql(20) + f"""
SELECT c.query_id, c.id, wr.code AS camelot, {compat_sql('wq.code', 'wr.code')} AS compatibility,
  {bpm_sql('q.bpm', 's.bpm')} AS bpm_match, floor(s.bpm - q.bpm + 0.5)::BIGINT AS bpm_diff
FROM cand c JOIN songs q ON q.id = c.query_id JOIN songs s ON s.id = c.id
LEFT JOIN wheel wq ON wq.k = q.musical_key LEFT JOIN wheel wr ON wr.k = s.musical_key""")
def d12(spark, sf):
    songs = V.vectors(spark, sf)
    _, cand = _candidates(songs, 20)
    return RS.harmonic(cand, songs).select(
        "query_id", "id", "camelot", "compatibility", "bpm_match", "bpm_diff")


@query("d13_display_score", "WITH " + pool_sql(20) + """
SELECT query_id, id, CASE WHEN hi - lo > 0.001
    THEN floor(60 + (similarity - lo) / (hi - lo) * 39 + 0.5)
    ELSE floor(similarity * 100 + 0.5) END::BIGINT AS display
FROM (SELECT *, min(similarity) OVER (PARTITION BY query_id) AS lo,
        max(similarity) OVER (PARTITION BY query_id) AS hi FROM cand)""")
def d13(spark, sf):
    _, cand = _candidates(V.vectors(spark, sf), 20)
    return RS.display_score(cand).select("query_id", "id", "display")


@query("d14_similarity_label", "WITH " + pool_sql(20) + """
SELECT query_id, id, CASE WHEN similarity * 2.2 >= 0.9 THEN 'very similar'
  WHEN similarity * 2.2 >= 0.7 THEN 'similar' ELSE 'distant' END AS label FROM cand""")
def d14(spark, sf):
    # Random vectors are far apart; the score is scaled so that all labels occur.
    _, cand = _candidates(V.vectors(spark, sf), 20)
    return cand.select("query_id", "id",
                       RS.similarity_label(F.col("similarity") * 2.2).alias("label"))


def radar_sql(v: str) -> dict[str, str]:
    clamp = lambda x: f"greatest(0.0, least(1.0, {x}))"
    at = lambda i: f"{v}[{i + 1}]"
    return {
        "timbre": f"least(1.0, sqrt(list_sum(list_transform({v}[2:13], lambda x: x * x)) / 12))",
        "harmony": f"least(1.0, list_sum(list_transform({v}[27:38], lambda x: abs(x))) / 12)",
        "rhythm": f"0.5 * CASE WHEN {at(40)} > 0 THEN {clamp(f'({at(40)} - 60) / 140')} ELSE 0 END"
                  f" + 0.5 * {clamp(at(43))}",
        "brightness": f"0.5 * {clamp(at(38))} + 0.5 * {clamp(at(39))}",
        "intensity": f"0.6 * {clamp(at(42))} + 0.4 * {clamp(at(41))}",
    }


RADAR_CTE = "radar AS (SELECT id, " + ", ".join(
    f"round({e}, 3)::DOUBLE AS {a}" for a, e in radar_sql("handcrafted_norm").items()) + " FROM songs)"


@query("e21_radar", "WITH " + RADAR_CTE + " SELECT * FROM radar")
def e21(spark, sf):
    return RS.radar(V.vectors(spark, sf))


@query("d15_explain", "WITH " + RADAR_CTE + ", " + pool_sql(20) + " SELECT c.query_id, c.id, "
       + ", ".join(f"CASE WHEN round(abs(a.{x} - b.{x}), 9) < 0.15 THEN 'similar' "
                   f"WHEN round(abs(a.{x} - b.{x}), 9) < 0.35 "
                   f"THEN 'medium' ELSE 'less' END AS {x}" for x in L.FOCUS)
       + ", concat_ws(',', " + ", ".join(
           f"CASE WHEN round(abs(a.{x} - b.{x}), 9) < 0.15 THEN '{x}' END" for x in L.FOCUS)
       + ") AS alike FROM cand c JOIN radar a ON a.id = c.query_id JOIN radar b ON b.id = c.id")
def d15(spark, sf):
    songs = V.vectors(spark, sf)
    _, cand = _candidates(songs, 20)
    return RS.explain(cand, RS.radar(songs)).select(
        "query_id", "id", *L.FOCUS, F.array_join("alike", ",").alias("alike"))


def measured(queries, songs):
    """Exact hits of the default approximate search, and whether it found nine of ten."""
    exact = S.top_k(queries, songs, 10, exclude="query_id", filter_mode="pre")
    approx = S.top_k(queries, songs, 10, exclude="query_id", filter_mode="pre", method="approx")
    return S.recall(approx, exact).select("exact_hits", (F.col("recall") >= 0.9).alias("reached"))


@query("d16_approximate_recall", "SELECT count(*) * 10 AS exact_hits, true AS reached FROM songs")
def d16(spark, sf):
    songs = V.vectors(spark, sf)
    return measured(self_queries(songs), songs)


@query("d16_recall_target", "SELECT 1 AS times, count(*) * 10 AS exact_hits, true AS reached FROM songs "
       "UNION ALL SELECT 6, count(*) * 10, true FROM songs")
def d16_target(spark, sf):
    """The same defaults on the catalogue and on six times as many songs: the others with turned vectors."""
    songs = V.vectors(spark, sf).select("id", "bpm", "metadata_status", "learned", "handcrafted_norm", "mert", "genre")
    turn = F.explode(F.sequence(F.lit(0), F.lit(5)))
    more = songs.withColumn("t", turn).withColumn("learned", F.when(F.col("t") == 0, F.col("learned")).otherwise(
        F.concat(F.slice("learned", F.col("t") * 7 + 1, F.size("learned") - F.col("t") * 7),
                 F.slice("learned", F.lit(1), F.col("t") * 7)))).withColumn(
        "id", F.col("id") + F.col("t").cast("long") * 1_000_000_000).drop("t")
    asked = self_queries(songs)
    return measured(asked, songs).select(F.lit(1).alias("times"), "*").unionByName(
        measured(asked, more).select(F.lit(6).alias("times"), "*"))


@query("d1_mixed_lengths", """
WITH v AS (SELECT id, bpm, CASE WHEN id % 7 = 0 THEN learned[1:60] ELSE learned END AS learned FROM songs),
pairs AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.learned, b.learned), 12) AS similarity
  FROM songs a CROSS JOIN v b WHERE len(b.learned) = 64 AND b.id % 11 <> 0 AND b.bpm IS NOT NULL AND a.id <> b.id
    AND a.id % 7 <> 0 AND a.id % 11 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM pairs)
""" + FINAL + "r WHERE rank <= 20")
def d1_mixed(spark, sf):
    """Every seventh vector is shortened and every eleventh has a NaN; they take no part."""
    n = F.col("id")
    v = F.col("learned")
    broken = V.vectors(spark, sf).withColumn("learned", F.when(n % 7 == 0, F.slice(v, 1, 60)).when(
        n % 11 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice(v, 2, 63))).otherwise(v))
    return shown(S.top_k(self_queries(broken), broken, 20, exclude="query_id", max_bpm=1e9, min_bpm=-1e9,
                         filter_mode="post", strategy="cells", n_pivots=4))


@query("d1_top_k_cells", "WITH " + pool_sql(20) + FINAL + "cand")
def d1_cells(spark, sf):
    """The shuffle strategy of the exact search: same rows as the broadcast one."""
    songs = V.vectors(spark, sf)
    return shown(S.top_k(self_queries(songs), songs, 20, exclude="query_id", strategy="cells",
                         n_pivots=4, block_rows=1024))


@query("d17_result_filter", "WITH " + CAMELOT_CTE + ", " + pool_sql(20) + """
SELECT c.query_id, c.id, round(c.similarity, 6) AS similarity, c.rank::BIGINT AS rank
FROM cand c JOIN songs s ON s.id = c.id JOIN wheel w ON w.k = s.musical_key
WHERE s.bpm BETWEEN 90 AND 150 AND w.code IN ('8A', '8B', '9A', '7A') AND c.similarity >= 0.2""")
def d17(spark, sf):
    songs = V.vectors(spark, sf)
    _, cand = _candidates(songs, 20)
    return shown(RS.filter_results(cand, songs, min_bpm=90, max_bpm=150,
                                   codes=("8A", "8B", "9A", "7A"), min_sim=0.2))
