"""Recommendation compositions (inventory D7-D9, D11, H1, H2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundalike.functions.layout import FOCUS
from soundalike.functions.vectors import midpoint
from soundalike.operators import rank as R
from soundalike.operators.search import nearest, top_k
from soundalike.session import cut

OVERFETCH = 3
MIN_SEEDS, MAX_SEEDS = 2, 5


def _with_song(queries: DataFrame, songs: DataFrame, key: str = "song_id") -> DataFrame:
    """Attach the query song's vectors and genre."""
    seed = songs.select(F.col("id").alias(key), F.col("learned").alias("vector"),
                        F.col("handcrafted_norm").alias("handcrafted"), "mert", "genre")
    return queries.join(seed, key)


def similar(queries: DataFrame, songs: DataFrame, limit: int = 20, *,
            min_bpm: float = 0, max_bpm: float = 999, focus: str | None = None,
            genre_weights: DataFrame | None = None, min_sim: float = R.MIN_SIMILARITY,
            lam: float = R.MMR_LAMBDA, layout: Mapping[str, Sequence[int]] = FOCUS,
            method: str = "exact", max_extra: int | None = None, **search) -> DataFrame:
    """Similar songs for every row of ``queries``.

    The pool grows by one song for every excluded id, so lists stay full; ``max_extra`` bounds that.

    ``queries``: ``query_id, song_id`` and optionally ``exclude_ids`` (array) and
    ``focus``.  Result: ``query_id, id, similarity, rank``; ``rank`` is the order
    after diversification.
    """
    asked = _with_song(queries, songs)
    excluding = "exclude_ids" in queries.columns
    count = None
    if excluding:
        extra = F.size(F.array_distinct(F.coalesce(
            F.col("exclude_ids"), F.expr("slice(array(song_id), 1, 0)"))))
        if max_extra is None:
            max_extra = asked.agg(F.max(extra)).first()[0] or 0
        extra = F.least(F.lit(max_extra), extra)
        asked = asked.withColumn("fetch", (F.lit(limit * OVERFETCH) + extra).cast("int"))
        count = "fetch"
    pool = top_k(asked, songs, limit * OVERFETCH + (max_extra if excluding else 0),
                 min_bpm=min_bpm, max_bpm=max_bpm, exclude="song_id", match_count=count,
                 method=method, **search)
    if excluding:
        pool = (pool.join(asked.select("query_id", "exclude_ids"), "query_id")
                .where(~F.coalesce(F.array_contains("exclude_ids", F.col("id")), F.lit(False)))
                .drop("exclude_ids"))
    fused = R.fuse(pool, asked, R.with_version_key(songs), genre_weights, focus,
                   carry=("version_key", "learned"), layout=layout, renumber=False)
    ranked = R.mmr(R.dedup_versions(fused, by_score=True), limit, lam=lam)
    return R.min_similarity(ranked, min_sim)


def blend(pairs: DataFrame, songs: DataFrame, limit: int = 20, *,
          min_sim: float = R.MIN_SIMILARITY, layout: Mapping[str, Sequence[int]] = FOCUS,
          **search) -> DataFrame:
    """Songs around the midpoint of two songs.  ``pairs``: ``query_id, song_a, song_b``."""
    side = songs.select("id", "learned", "handcrafted_norm")
    a = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns])
    b = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    asked = (pairs.join(a, F.col("song_a") == F.col("id_a"))
             .join(b, F.col("song_b") == F.col("id_b"))
             .select("query_id", "song_a", "song_b",
                     midpoint("learned_a", "learned_b").alias("vector"),
                     midpoint("handcrafted_norm_a", "handcrafted_norm_b").alias("handcrafted")))
    pool = top_k(asked, songs, limit * OVERFETCH + 2, **search)
    pool = (pool.join(asked.select("query_id", "song_a", "song_b"), "query_id")
            .where((F.col("id") != F.col("song_a")) & (F.col("id") != F.col("song_b")))
            .drop("song_a", "song_b"))
    fused = R.fuse(pool, asked.select("query_id", "handcrafted"), R.with_version_key(songs),
                   mert=None, carry=("version_key",), layout=layout, renumber=False)
    ranked = R.head(R.dedup_versions(fused, by_score=True), limit).select("query_id", "id", "similarity", "rank")
    return R.min_similarity(ranked, min_sim)


def intersect_lists(lists: DataFrame, at_least: str = "needed") -> DataFrame:
    """H1: items in at least ``needed`` lists of a query, scored by their lowest similarity.

    ``lists``: ``query_id, id, similarity, pos, rank, needed``; a list that occurs
    twice counts twice.  Equal scores keep the order of first appearance.
    """
    return (lists.groupBy("query_id", "id")
            .agg(F.count("*").alias("lists"), F.min("similarity").alias("similarity"),
                 F.min(F.struct("pos", "rank")).alias("first"), F.max(at_least).alias("needed"))
            .where(F.col("lists") >= F.col("needed"))
            .select("query_id", "id", "similarity", "first"))


def append_missing(first: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """H2: append rows of ``more`` that ``first`` lacks until a query has ``limit`` rows.

    Both: ``query_id, id, similarity, rank``.  Rows of ``first`` are all kept and
    come first; the appended rows are not sorted into them.
    """
    fresh = more.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = first.withColumn("tier", F.lit(0)).unionByName(fresh.withColumn("tier", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy("tier", "rank", "id")
    return (both.withColumn("rank", F.row_number().over(order))
            .where((F.col("tier") == 0) | (F.col("rank") <= limit)).drop("tier"))


def vibe(seed_sets: DataFrame, songs: DataFrame, limit: int = 20, *, per_seed: int = 100,
         min_sim: float = R.MIN_SIMILARITY, **search) -> DataFrame:
    """Songs close to several seeds.  ``seed_sets``: ``query_id, song_ids``.

    Sets of fewer than two or more than five ids are not valid and give no rows;
    :func:`invalid_sets` returns them with the reason.

    Seed sets, narrow songs, the queries of both searches and the common songs are worked out once each, so no plan
    holds more than one search, and none of them is planned, broadcast or run again for each step of a search.
    """
    seed_sets = cut(seed_sets.where(F.size("song_ids").between(MIN_SEEDS, MAX_SEEDS)).select("query_id", "song_ids"))
    named, needed = songs, {"id", "learned", "bpm", "metadata_status", search.get("vec"), search.get("extra")}
    songs = cut(songs.select(*[c for c in songs.columns if c in needed]))
    seeds = seed_sets.select(
        "query_id", F.size("song_ids").alias("n"),
        F.posexplode("song_ids").alias("pos", "song_id"))
    vectors = songs.select(F.col("id").alias("song_id"), F.col("learned").alias("vector"))
    # A song that seeds many sets is searched once.
    distinct = cut(vectors.join(seeds.select("song_id"), "song_id", "left_semi")
                   .select(F.col("song_id").alias("query_id"), "vector"))
    lists = top_k(distinct, songs, per_seed, **search).withColumnRenamed("query_id", "song_id")
    not_seed = ~F.array_contains("song_ids", F.col("id"))
    per_set = (seeds.join(lists, "song_id")
               .withColumn("needed", F.least(F.lit(2), F.col("n")))
               .join(seed_sets.select("query_id", "song_ids"), "query_id")
               .where(not_seed))
    common = intersect_lists(per_set)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "first", "id")
    common = cut(common.withColumn("rank", F.row_number().over(order))
                 .select("query_id", "id", "similarity", "rank"))

    # At most five vectors per set, so averaging them is a row-wise expression.
    total = F.aggregate(
        F.slice("vs", 2, MAX_SEEDS), F.get("vs", F.lit(0)),
        lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    centres = (seeds.join(vectors, "song_id")
               .groupBy("query_id").agg(F.collect_list("vector").alias("vs"))
               .select("query_id", F.transform(total, lambda x: x / F.size("vs")).alias("vector"))
               .join(seed_sets, "query_id")
               .withColumn("fetch", F.lit(limit) + F.size(F.array_distinct("song_ids"))))
    centres = cut(centres.select("query_id", "vector", "fetch"))
    fallback = (top_k(centres, songs, limit + MAX_SEEDS, match_count="fetch", **search)
                .join(seed_sets, "query_id").where(not_seed).drop("song_ids"))
    merged = append_missing(common, fallback, limit)
    ranked = R.head(R.dedup_versions(merged, named), limit)
    return R.min_similarity(ranked.select("query_id", "id", "similarity", "rank"), min_sim)


def invalid_sets(seed_sets: DataFrame) -> DataFrame:
    """Seed sets that :func:`vibe` does not answer: ``query_id, reason``."""
    n = F.size("song_ids")
    reason = (F.when(F.col("song_ids").isNull(), "no_seeds").when(n < MIN_SEEDS, "too_few")
              .when(n > MAX_SEEDS, "too_many"))
    return seed_sets.select("query_id", reason.alias("reason")).where("reason is not null")


def journeys(starts: DataFrame, songs: DataFrame, steps: int, *, fanout: int = 5,
             min_bpm: float = 0, max_bpm: float = 999, focus: str | None = None,
             genre_weights: DataFrame | None = None, min_sim: float = R.MIN_SIMILARITY,
             layout: Mapping[str, Sequence[int]] = FOCUS, pool_factor: int = 5, **search) -> DataFrame:
    """Greedy walks.  ``starts``: ``journey_id, song_id``.

    Every step takes the first similar song (``similar`` with ``limit=fanout``) that the walk has not visited.
    Result: ``journey_id, step, song_id, similarity``.

    Walks go over a graph: the nearest songs of a song are searched once, when the first walk reaches it, whatever
    the number of walks and steps that meet there.  A step is a join of the walks with the graph, then the
    fusion of what each has not visited; the first of a diversified list is the best fused one, so neither
    versions nor diversity need to be worked out.  Each round is checkpointed, so the plan does not grow.
    """
    most = fanout * OVERFETCH + steps  # a walk of n steps leaves out n songs and asks for as many more
    facts = songs.select("id", "handcrafted_norm", "mert", "genre")
    state = starts.select(
        "journey_id", F.lit(0).alias("step"), "song_id", F.lit(0.0).alias("similarity"),
        F.array("song_id").alias("visited"))
    trail, graph, known = [state.drop("visited")], None, None
    for step in range(1, steps + 1):
        reached = state.select("song_id").distinct()
        fresh = cut(reached if known is None else reached.join(known, "song_id", "left_anti"))
        if not fresh.isEmpty():
            asked = songs.select(F.col("id").alias("song_id"), F.col("learned").alias("vector")).join(fresh, "song_id")
            near = nearest(asked.withColumnRenamed("song_id", "query_id"), songs, most * pool_factor, **search)
            near = cut(near.where(F.col("extra").between(min_bpm, max_bpm) & (F.col("id") != F.col("query_id"))).select(
                F.col("query_id").alias("song_id"), "id", "similarity", "rank"))
            graph = near if graph is None else graph.unionByName(near)
            known = fresh if known is None else known.unionByName(fresh)
        if graph is None:
            break
        wanted = F.lit(fanout * OVERFETCH) + F.size(F.array_distinct("visited"))
        walk = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        pool = (state.select(F.col("journey_id").alias("query_id"), "song_id", "visited", wanted.alias("wanted"))
                .join(graph, "song_id").where(F.col("rank") <= F.col("wanted") * pool_factor)
                .withColumn("rank", F.row_number().over(walk)).where(F.col("rank") <= F.col("wanted"))
                .where(~F.array_contains("visited", F.col("id"))).select("query_id", "id", "similarity", "rank"))
        queries = state.select(F.col("journey_id").alias("query_id"), "song_id").join(
            facts.select(F.col("id").alias("song_id"), F.col("handcrafted_norm").alias("handcrafted"), "mert", "genre"), "song_id")
        fused = R.fuse(pool, queries, songs, genre_weights, focus, layout=layout, renumber=False)
        first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "rank", "id")
        chosen = (fused.withColumn("n", F.row_number().over(first)).where("n = 1")
                  .where(F.col("similarity") >= min_sim)
                  .select(F.col("query_id").alias("journey_id"), F.col("id").alias("next"),
                          F.col("similarity").alias("sim")))
        state = cut(state.join(chosen, "journey_id").select(
            "journey_id", F.lit(step).alias("step"), F.col("next").alias("song_id"),
            F.col("sim").alias("similarity"),
            F.array_append("visited", F.col("next")).alias("visited")))
        trail.append(state.drop("visited"))
    out = trail[0]
    for part in trail[1:]:
        out = out.unionByName(part)
    return out


def journey_stats(path: DataFrame, songs: DataFrame) -> DataFrame:
    """Steps, distance ``sum(1 - similarity)`` (the start counts 1), distinct genres."""
    return (path.join(songs.select(F.col("id").alias("song_id"), "genre"), "song_id", "left")
            .groupBy("journey_id")
            .agg(F.count("*").alias("steps"),
                 F.sum(1 - F.col("similarity")).alias("distance"),
                 F.count_distinct(F.when(F.col("genre") != "", F.col("genre"))).alias("genres")))
