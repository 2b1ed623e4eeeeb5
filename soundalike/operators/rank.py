"""Re-ranking of candidate lists (inventory D3-D6, B8, F1, G2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from soundalike.functions.layout import FOCUS
from soundalike.functions.text import base_title
from soundalike.functions.vectors import (
    category_part, category_units, dot, has_weights, normalised_weights, packed, unit, unpacked)

MIN_SIMILARITY = 0.3
MMR_LAMBDA = 0.7


def fusion_weights(focus: Column, has_mert: Column, genre_weights: Column) -> Column:
    """D3: struct(learned, mert, handcrafted) for one query."""
    triple = lambda a, b, c: F.struct(
        F.round(a, 12).alias("learned"), F.round(b, 12).alias("mert"),
        F.round(c, 12).alias("handcrafted"))
    lit = F.lit
    total = F.aggregate(F.map_values(genre_weights), lit(0.0), lambda s, x: s + x)
    sure = F.least(lit(1.0), 2 * total)
    with_mert, without = 0.15 + 0.15 * sure, 0.2 + 0.2 * sure
    known = focus.isin(*FOCUS)
    return (
        F.when(known & has_mert, triple(lit(0.55), lit(0.15), lit(0.30)))
        .when(known, triple(lit(0.60), lit(0.0), lit(0.40)))
        .when(has_weights(genre_weights) & has_mert,
              triple(1.0 - with_mert - 0.15, lit(0.15), with_mert))
        .when(has_weights(genre_weights), triple(1.0 - without, lit(0.0), without))
        .when(has_mert, triple(lit(0.65), lit(0.15), lit(0.20)))
        .otherwise(triple(lit(0.80), lit(0.0), lit(0.20))))


def weight_maps(genre_weights: DataFrame) -> DataFrame:
    """``genre, weights map<category, weight>`` of a listed weight table."""
    return genre_weights.groupBy("genre").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "focus_category", F.col("weight").cast("double")))).alias("weights"))


def _prepared_queries(queries: DataFrame, genre_weights: DataFrame | None, focus: str | None,
                      layout: Mapping[str, Sequence[int]]) -> DataFrame:
    """Everything about a query that does not depend on the candidate."""
    cols = set(queries.columns)
    q = queries.withColumn("focus", F.lit(focus).cast("string")) if (
        focus is not None or "focus" not in cols) else queries
    for name, kind in (("mert", "array<double>"), ("genre", "string")):
        if name not in cols:
            q = q.withColumn(name, F.lit(None).cast(kind))
    empty = F.lit(None).cast("map<string,double>")
    if genre_weights is None:
        q = q.withColumn("weights", empty)
    else:
        # Genres are few and unevenly used: ids and weights meet on them, the queries' vectors do not.
        maps = (q.select("query_id", "genre").join(weight_maps(genre_weights), "genre")
                .select("query_id", "weights"))
        q = q.join(maps, "query_id", "left").withColumn(
            "weights", F.when(F.col("focus").isNull(), F.col("weights")))
    w = F.col("weights")
    shares = normalised_weights(w, layout)
    factor = {name: F.when(F.col("focus").isNotNull(),
                           F.when(F.col("focus") == name, 1.0).otherwise(0.0))
              .otherwise(shares[name]) for name in layout}
    by_category = F.col("focus").isin(*layout) | has_weights(w)
    by_category = F.coalesce(by_category, F.lit(False))
    hc, mert = F.col("handcrafted"), F.col("mert")
    return q.select(
        "query_id", by_category.alias("by_category"),
        fusion_weights(F.col("focus"), F.lit(True), w).alias("w_mert"),
        fusion_weights(F.col("focus"), F.lit(False), w).alias("w_plain"),
        F.when(by_category, category_units(hc, layout, factor)).otherwise(unit(hc)).alias("q_hc"),
        F.when(F.size(mert) > 0, unit(mert)).alias("q_mert"),
        (F.size(hc) > 0).alias("q_has_hc"))


def fuse(candidates: DataFrame, queries: DataFrame, songs: DataFrame,
         genre_weights: DataFrame | None = None, focus: str | None = None, *,
         hc: str = "handcrafted_norm", mert: str | None = "mert",
         carry: Sequence[str] = (), layout: Mapping[str, Sequence[int]] = FOCUS,
         renumber: bool = True) -> DataFrame:
    """Late fusion of learned, transformer and handcrafted similarity.

    ``candidates``: ``query_id, id, similarity, rank``.  ``queries``: ``query_id,
    handcrafted`` and optionally ``mert, genre, focus``.  The score replaces
    ``similarity``; ``rank`` is renewed, or left as the tie-breaker it was with
    ``renumber=False`` (for :func:`dedup_versions`, which saves a sort).  Whether the transformer term counts is
    decided over a query's whole candidate list.  A candidate without a
    handcrafted vector, and every candidate of a query without one, keeps the
    similarity it came with.

    The wide song vectors move once: candidates meet songs on ``id``, and the
    result stays partitioned by ``query_id`` for all later steps.  If all queries have one ``focus``,
    only its elements of the handcrafted vectors move.
    """
    handcrafted = F.col(hc)
    if focus in layout:
        handcrafted = category_part(hc, focus, layout)
        queries = queries.withColumn("handcrafted", category_part("handcrafted", focus, layout))
        layout = {focus: range(len(layout[focus]))}
    vectors = songs.select(
        "id", handcrafted.alias("_hc"),
        (F.col(mert) if mert else F.lit(None).cast("array<double>")).alias("_mert"), *carry)
    per_category = focus is not None or genre_weights is not None or "focus" in queries.columns
    r_cat = category_units("_hc", layout) if per_category else F.lit(None).cast("array<double>")
    # They travel as they came, in four bytes an element where that is exact; units are made where they meet.
    vectors = vectors.select("id", *carry, packed("_hc").alias("_hc"), packed("_mert").alias("_mert"))
    q = _prepared_queries(queries, genre_weights, focus, layout)
    both = candidates.join(vectors, "id", "left").join(q, "query_id", "left")
    both = both.withColumns({"_hc": unpacked("_hc"), "_mert": unpacked("_mert")})
    both = both.withColumns({
        "r_hc": F.when(F.size("_hc") > 0, F.when(F.col("by_category"), r_cat).otherwise(unit("_hc"))),
        "r_mert": F.when(F.size("_mert") > 0, unit("_mert"))})

    # The vectors end here: what the window below buffers per query is a few numbers per candidate.
    both = both.select(
        "query_id", "id", "similarity", "rank", *carry, "w_mert", "w_plain", "q_has_hc",
        dot("q_hc", "r_hc").alias("hc_sim"),
        dot("q_mert", "r_mert").alias("mert_sim"), F.col("r_hc").isNotNull().alias("r_has_hc"),
        F.col("r_mert").isNotNull().alias("r_has_mert"), F.col("q_mert").isNotNull().alias("q_has_mert"))
    pool = Window.partitionBy("query_id")
    both = both.withColumn("has_mert", F.col("q_has_mert") & F.coalesce(
        F.max("r_has_mert").over(pool), F.lit(False)))
    share = {n: F.when(F.col("has_mert"), F.col(f"w_mert.{n}")).otherwise(F.col(f"w_plain.{n}"))
             for n in ("learned", "mert", "handcrafted")}
    mert_sim = F.when(F.col("has_mert") & F.col("r_has_mert"), F.col("mert_sim")).otherwise(F.lit(0.0))
    fused = (share["learned"] * F.col("similarity") + share["mert"] * mert_sim
             + share["handcrafted"] * F.col("hc_sim"))
    applies = F.coalesce(F.col("q_has_hc"), F.lit(False)) & F.col("r_has_hc")
    scored = both.withColumn("similarity", F.round(
        F.when(applies, fused).otherwise(F.col("similarity")), 12))
    if renumber:
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "rank", "id")
        scored = scored.withColumn("rank", F.row_number().over(order))
    return scored.select("query_id", "id", "similarity", "rank", *carry)


def version_key(title: Column | str = "title", artist: Column | str = "artist") -> Column:
    """What all versions of one track share: artist and base title."""
    return F.concat_ws("||", F.lower(F.coalesce(artist, F.lit(""))),
                       base_title(F.coalesce(title, F.lit(""))))


def with_version_key(songs: DataFrame) -> DataFrame:
    """Songs with ``version_key``, computed once per song and not once per candidate."""
    return songs.withColumn("version_key", version_key())


def dedup_versions(ranked: DataFrame, songs: DataFrame | None = None, *,
                   by_score: bool = False) -> DataFrame:
    """Keep the best ranked row per ``version_key``; ranks are renewed.

    The key is a column of ``ranked``, or is looked up in ``songs`` by ``id``.
    With ``by_score`` the order is (similarity, rank, id), else rank alone.
    """
    named = ranked if songs is None else ranked.join(
        with_version_key(songs).select("id", "version_key"), "id", "left")
    by = (F.desc("similarity"), F.asc("rank"), F.asc("id")) if by_score else (F.asc("rank"),)
    first = Window.partitionBy("query_id", "version_key").orderBy(*by)
    order = Window.partitionBy("query_id").orderBy(*by)
    return (named.withColumn("_n", F.row_number().over(first)).where("_n = 1")
            .drop("_n", "version_key").withColumn("rank", F.row_number().over(order)))


def head(ranked: DataFrame, limit: int) -> DataFrame:
    return ranked.where(F.col("rank") <= limit)


def _mmr_picks(relevance: np.ndarray, units: np.ndarray, present: np.ndarray, limit: int,
               lam: float) -> list[int]:
    """Greedy picks of one bounded pool, in order."""
    n = len(relevance)
    nearest_pick = np.zeros(n)
    seen_any = False
    picks, free = [0], np.ones(n, dtype=bool)
    free[0] = False
    while len(picks) < limit and free.any():
        last = picks[-1]
        if present[last]:
            sims = units @ units[last]
            nearest_pick = np.where(
                present, np.maximum(nearest_pick, sims) if seen_any else sims, 0.0)
            seen_any = True
        score = np.where(free, lam * relevance - (1 - lam) * nearest_pick, -np.inf)
        pick = int(np.argmax(np.round(score, 12)))
        picks.append(pick)
        free[pick] = False
    return picks


def mmr(ranked: DataFrame, limit: int, *, songs: DataFrame | None = None, vec: str = "learned",
        lam: float = MMR_LAMBDA, keep: Sequence[str] = ()) -> DataFrame:
    """Maximal marginal relevance.  Ranks become the order of selection.

    Greedy selection is sequential within a query; a query's pool is bounded by
    the candidate count, so queries run in parallel as bounded groups.
    """
    rows = ranked if songs is None else ranked.join(songs.select("id", vec), "id", "left")
    rows = rows.select("query_id", "id", "similarity", "rank", *keep, F.col(vec).alias("_vec"))
    out = T.StructType([f for f in rows.schema.fields if f.name != "_vec"])

    shape = to_arrow_schema(out)

    def pick(pool: pa.Table) -> pa.Table:
        order = np.argsort(pool.column("rank").to_numpy(), kind="stable")
        vec = pool.column("_vec").combine_chunks()
        has = np.asarray(vec.is_valid())[order]
        if len(order) > limit and has.any():
            present = vec.drop_null().flatten().to_numpy(zero_copy_only=False)
            rows = present.reshape(int(has.sum()), -1)
            m = np.zeros((len(order), rows.shape[1]))
            m[np.asarray(vec.is_valid())] = rows
            m = m[order]
            norms = np.sqrt((m * m).sum(axis=1))
            m /= np.where(norms > 0, norms, 1.0)[:, None]
            relevance = pool.column("similarity").to_numpy()[order]
            order = order[_mmr_picks(relevance, m, has, limit, lam)]
        order = order[:limit]
        chosen = pool.select(shape.names).take(pa.array(order))
        ranks = pa.array(np.arange(1, len(order) + 1), type=shape.field("rank").type)
        return chosen.set_column(chosen.schema.get_field_index("rank"), "rank", ranks).cast(shape)

    return rows.groupBy("query_id").applyInArrow(pick, out)


def min_similarity(ranked: DataFrame, floor: float = MIN_SIMILARITY) -> DataFrame:
    """Applied last, so fewer rows than the limit may remain."""
    return ranked.where(F.col("similarity") >= floor)
