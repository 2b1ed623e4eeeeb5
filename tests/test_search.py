"""Search strategies and re-ranking against small numpy re-statements."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundalike.functions.layout import FOCUS
from soundalike.functions.vectors import category_part, category_units, dot, packed, unpacked
from soundalike.operators import rank as R
from soundalike.operators import approximate as A
from soundalike.operators import search as S
from soundalike.plans import recommend as P

SCHEMA = ("id long, title string, artist string, genre string, bpm double, metadata_status string, "
          "learned array<double>, handcrafted_norm array<double>, mert array<double>")


def catalogue(n=60, d=6, seed=0, copies=0.0, zeros=0):
    rng = np.random.default_rng(seed)
    rows = []
    shared = rng.normal(size=d)
    for i in range(n):
        v = shared if rng.random() < copies else rng.normal(size=d)
        if i < zeros:
            v = np.zeros(d)
        rows.append((
            i, f"Track {i // 3}" + (" (Live)" if i % 3 else ""), f"artist {i % 4}",
            None if i % 11 == 0 else f"g{i % 3}", None if i % 9 == 0 else 60.0 + i,
            "failed" if i % 13 == 0 else "complete", [float(x) for x in v],
            None if i % 10 == 3 else [float(x) for x in rng.normal(size=44)],
            [float(x) for x in rng.normal(size=5)] if i % 2 else None))
    return rows


def cos(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if na == 0 or nb == 0 else float(np.dot(a, b) / (na * nb))


def brute_top(query, rows, k):
    scored = [(-round(cos(query, r[6]), 12), r[0]) for r in rows if np.linalg.norm(r[6]) > 0]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def brute_search(qid, query, rows, k, exclude=None, pool=5):
    by_id = {r[0]: r for r in rows}
    found = [(i, s) for i, s in brute_top(query, rows, k * pool)
             if i != exclude and by_id[i][4] is not None and 0 <= by_id[i][4] <= 999]
    return found[:k]


def as_queries(df):
    return df.select(F.col("id").alias("query_id"), F.col("learned").alias("vector"),
                     F.col("handcrafted_norm").alias("handcrafted"), "mert", "genre")


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.similarity, 9)))
    return out


@pytest.mark.parametrize("strategy,kw", [
    ("scan", {}), ("cells", {"n_pivots": 5, "block_rows": 7}), ("cells", {"n_pivots": 1, "block_rows": 1000})])
@pytest.mark.parametrize("copies,zeros", [(0.0, 0), (0.4, 3)])
def test_strategies_agree_with_brute_force(spark, strategy, kw, copies, zeros):
    rows = catalogue(copies=copies, zeros=zeros)
    songs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = listed(S.top_k(as_queries(songs), songs, 6, exclude="query_id", strategy=strategy, **kw))
    for r in rows:
        if np.linalg.norm(r[6]) == 0:
            assert r[0] not in got
            continue
        want = [(i, round(s, 9)) for i, s in brute_search(r[0], r[6], rows, 6, r[0])]
        assert got.get(r[0], []) == want


def test_pool_larger_than_catalogue_and_text_ids(spark):
    rows = [(f"s{r[0]:02d}", *r[1:]) for r in catalogue(12)]
    songs = spark.createDataFrame(rows, SCHEMA.replace("id long", "id string", 1))
    for strategy in ("scan", "cells"):
        got = listed(S.top_k(as_queries(songs), songs, 50, exclude="query_id", strategy=strategy))
        for r in rows:
            assert [i for i, _ in got[r[0]]] == [i for i, _ in brute_search(r[0], r[6], rows, 50, r[0])]


def test_too_many_queries_for_scan(spark):
    songs = spark.createDataFrame(catalogue(20), SCHEMA)
    with pytest.raises(ValueError):
        S.nearest(as_queries(songs), songs, 3, strategy="scan", max_scan_queries=5)
    auto = S.nearest(as_queries(songs), songs, 3, max_scan_queries=5)
    scan = S.nearest(as_queries(songs), songs, 3)
    assert listed(auto) == listed(scan)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), k=st.integers(1, 8), pivots=st.integers(1, 9))
def test_cells_are_exact(spark, seed, k, pivots):
    rows = catalogue(40, 4, seed, copies=0.3)
    songs = spark.createDataFrame(rows, SCHEMA)
    got = listed(S.nearest(as_queries(songs), songs, k, strategy="cells", n_pivots=pivots, block_rows=9))
    for r in rows:
        assert got[r[0]] == [(i, round(s, 9)) for i, s in brute_top(r[6], rows, k)]


def test_prefilter_caps_and_drops_failed(spark):
    rows = catalogue()
    songs = spark.createDataFrame(rows, SCHEMA)
    got = listed(S.top_k(as_queries(songs), songs, 500, exclude="query_id", filter_mode="pre",
                         cap=10, min_bpm=70, max_bpm=110))
    usable = [r for r in rows if r[4] is not None and 70 <= r[4] <= 110 and r[5] != "failed"]
    for r in rows:
        want = [i for i, _ in brute_top(r[6], [u for u in usable if u[0] != r[0]], 10)]
        assert [i for i, _ in got[r[0]]] == want


@pytest.mark.parametrize("n,dim,target", [(250, 8, 0.9), (2500, 24, 0.9), (900, 16, 0.6)])
def test_approximate_search_reaches_its_target(spark, n, dim, target):
    r = np.random.default_rng(n)
    v = r.normal(size=(n, dim)) + 1.5 * r.normal(size=(20, dim))[np.arange(n) % 20]
    songs = spark.createDataFrame([(i, x.tolist(), 100.0, "ok") for i, x in enumerate(v)],
                                  "id long, learned array<double>, bpm double, metadata_status string").repartition(4)
    q = songs.select(F.col("id").alias("query_id"), F.col("learned").alias("vector")).where("id % 3 = 0")
    plans = []
    approx = A.nearest(q, songs, 8, target=target, plans=plans)
    exact = S.nearest(q, songs, 8)
    row = S.recall(approx, exact).first()
    assert row.recall >= target and plans[0].recall >= target and row.exact_hits == 8 * -(-n // 3)
    scores = {(x.query_id, x.id): x.similarity for x in exact.collect()}
    assert all(abs(scores.get((x.query_id, x.id), x.similarity) - x.similarity) < 1e-9 for x in approx.collect())
    if n > 2000:  # effort follows the target, and is a part of the catalogue
        low = []
        A.nearest(q, songs, 8, target=0.5, plans=low).count()
        assert low[0].probes <= plans[0].probes < n ** 0.5 and plans[0].short < n / 4


def test_approximate_search_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "QUERY_BLOCK", 3)
    songs = spark.createDataFrame(
        [(i, [float(i % 5), 1.0, float(i)], 1.0) for i in range(30)] + [(100, None, 1.0), (101, [0.0] * 3, 1.0), (102, [1.0], 1.0),
         (103, [float("nan")] * 3, 1.0)], "id long, learned array<double>, bpm double")
    q = songs.select(F.col("id").alias("query_id"), F.col("learned").alias("vector"))
    got = A.nearest(q, songs, 50, target=1.0)
    assert sorted(map(tuple, got.select("query_id", "id").collect())) == sorted((a, b) for a in range(30) for b in range(30))
    assert A.nearest(q, songs.limit(0), 5).count() == 0 and A.nearest(q.limit(0), songs, 5, dim=3).count() == 0


@pytest.mark.parametrize("block", [4, 1000])
def test_approximate_search_runs_as_many_jobs_whatever_the_queries(spark, monkeypatch, block):
    """blocks of queries are tasks of one job, and the driver collects none of them."""
    monkeypatch.setattr(A, "QUERY_BLOCK", block)
    jobs, sc = [], spark.sparkContext
    collected, collect = [], type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: (collected.append(collect(self)), collected[-1])[1])
    for n in (130, 390):
        songs = spark.createDataFrame(catalogue(n, copies=0.0), SCHEMA).localCheckpoint()
        sc.setJobGroup(f"approx {block} {n}", "")
        got = listed(A.nearest(as_queries(songs), songs, 4, target=1.0))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"approx {block} {n}")))
        assert len(got) == n and all(len(x) == 4 for x in got.values())
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 6  # as stages are planned, not one more a block
    assert all(x.num_rows <= A.CHECKED * 4 for x in collected if x.column_names != ["vec"])


@pytest.mark.parametrize("block", [7, 1000])
def test_approximate_search_is_the_best_of_the_short_lists(spark, monkeypatch, block):
    """F1, F2: cells read, short lists by codes and exact scores, restated for all queries at once."""
    monkeypatch.setattr(A, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(300, 8)), np.ones((40, 8))]).astype("f4").astype("f8")
    songs = spark.createDataFrame([(f"s{i:03}", x.tolist(), i if i % 3 else None) for i, x in enumerate(v)],
                                  "id string, learned array<double>, bpm long").repartition(3)
    books, plans, fit = [], [], A.fit
    monkeypatch.setattr(A, "fit", lambda *a: (books.append(fit(*a)), books[-1])[1])
    got = A.nearest(songs.select(F.col("id").alias("query_id"), F.col("learned").alias("vector")), songs, 5, target=0.6, plans=plans)
    assert got.columns == ["query_id", "id", "similarity", "extra", "rank"]
    units, book, plan = S._units(v)[0], books[0], plans[0]
    cell, codes = book.code(units)
    rough = units.astype("f4") @ book.decoded(cell, codes).T
    place = A._nearest_cells(units, book)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.similarity, r.extra))
    sure = 0
    for i in range(len(v)):
        readable = np.flatnonzero(place[i][cell] < plan.probes)
        order = readable[np.lexsort((readable, -rough[i, readable]))]
        if len(order) > plan.short and abs(rough[i, order[plan.short - 1]] - rough[i, order[plan.short]]) < 1e-5:
            continue  # single precision may order these the other way
        exact = np.round(units @ units[i], S.DIGITS)
        best = sorted(order[:plan.short], key=lambda j: (-exact[j], j))[:5]
        assert [x[0] for x in found[f"s{i:03}"]] == [f"s{j:03}" for j in best]
        assert [x[2] for x in found[f"s{i:03}"]] == [int(j) if j % 3 else None for j in best]
        assert np.allclose([x[1] for x in found[f"s{i:03}"]], exact[best], atol=1e-9)
        sure += 1
    assert sure > 200


@pytest.mark.parametrize("odd", ["songs", "queries", "no id", "no query id"])
def test_approximate_search_with_repeated_and_missing_ids(spark, odd):
    songs = spark.createDataFrame(catalogue(60, copies=0.0), SCHEMA)
    asked = as_queries(songs).where("query_id < 9")
    want = {r.query_id: r for r in S.nearest(asked, songs, 3).where("rank = 1").collect()}
    if odd == "songs":
        songs = songs.unionByName(songs.where("id = 4"))
    if odd == "no id":
        songs = songs.withColumn("id", F.when(F.col("id") != 50, F.col("id")))
    if odd in ("queries", "no query id"):
        twin = asked.where("query_id = 4").withColumn("query_id", F.when(F.lit(odd == "queries"), F.col("query_id")))
        asked = asked.unionByName(twin)
    got = A.nearest(asked, songs, 3, target=1.0).collect()
    for q, r in want.items():
        rows = sorted((x.rank, x.id, round(x.similarity, 9)) for x in got if x.query_id == q)
        assert [x[0] for x in rows] == [1, 2, 3] and rows[0][1:] == (r.id, round(r.similarity, 9))
        assert len({x[1] for x in rows}) == (3 if q != 4 or odd in ("no id", "no query id") else 2 if odd == "queries" else 1)
    assert not [x for x in got if x.id is None]
    assert (sum(x.query_id is None for x in got) == 3) == (odd == "no query id")


# ------------------------------------------------------------- fusion, MMR, plans

def brute_fuse(pool, query, by_id, focus=None, weights=None):
    q_hc, q_mert = query[7], query[8]
    if q_hc is None:
        return pool
    has_mert = q_mert is not None and any(by_id[i][8] is not None for i, _ in pool)
    if focus:
        w = (0.55, 0.15, 0.30) if has_mert else (0.60, 0.0, 0.40)
    elif weights:
        c = min(1.0, sum(weights.values()) * 2)
        hc = 0.15 + 0.15 * c if has_mert else 0.2 + 0.2 * c
        w = (1 - hc - (0.15 if has_mert else 0), 0.15 if has_mert else 0.0, hc)
    else:
        w = (0.65, 0.15, 0.20) if has_mert else (0.80, 0.0, 0.20)

    def hc_sim(r):
        def part(cat):
            return cos([q_hc[d] for d in FOCUS[cat]], [r[d] for d in FOCUS[cat]])
        if focus:
            return part(focus)
        if weights:
            raw = {c: weights.get(c, 0.2) for c in FOCUS}
            return sum(v / sum(raw.values()) * part(c) for c, v in raw.items())
        return cos(q_hc, r)

    out = []
    for i, s in pool:
        r = by_id[i]
        if r[7] is not None:
            m = cos(q_mert, r[8]) if has_mert and r[8] is not None else 0.0
            s = w[0] * s + w[1] * m + w[2] * hc_sim(r[7])
        out.append((i, s))
    return sorted(out, key=lambda x: -round(x[1], 12))


def key_of(row):
    return row[2].lower(), row[1].replace(" (Live)", "").lower()


def brute_dedup(pool, by_id):
    seen, out = set(), []
    for i, s in pool:
        if key_of(by_id[i]) not in seen:
            seen.add(key_of(by_id[i]))
            out.append((i, s))
    return out


def brute_mmr(pool, by_id, limit, lam=0.7):
    if len(pool) <= limit:
        return pool
    chosen, rest = [pool[0]], list(pool[1:])
    while len(chosen) < limit and rest:
        scores = [lam * s - (1 - lam) * max(cos(by_id[i][6], by_id[j][6]) for j, _ in chosen)
                  for i, s in rest]
        chosen.append(rest.pop(int(np.argmax(np.round(scores, 12)))))
    return chosen


def brute_similar(qid, rows, limit, exclude=(), floor=0.3, focus=None, weights=None):
    by_id = {r[0]: r for r in rows}
    q = by_id[qid]
    k = limit * 3 + min(len(set(exclude)), 50)
    pool = [(i, s) for i, s in brute_search(qid, q[6], rows, k, qid) if i not in exclude]
    pool = brute_dedup(brute_fuse(pool, q, by_id, focus, weights), by_id)
    return [(i, round(s, 9)) for i, s in brute_mmr(pool, by_id, limit) if s >= floor]


@pytest.mark.parametrize("focus", [None, "rhythm", "timbre"])
def test_similar_matches_brute_force(spark, focus):
    rows = catalogue(80, copies=0.1)
    songs = spark.createDataFrame(rows, SCHEMA)
    asked = songs.select(F.col("id").alias("query_id"), F.col("id").alias("song_id"))
    got = listed(P.similar(asked, songs, 5, focus=focus))
    for r in rows:
        assert got.get(r[0], []) == brute_similar(r[0], rows, 5, focus=focus)


def test_similar_with_learned_genre_weights(spark):
    rows = catalogue(60)
    songs = spark.createDataFrame(rows, SCHEMA)
    table = {"g0": {"timbre": 0.1, "rhythm": 0.2}, "g1": {"harmony": 1.0}}
    weights = spark.createDataFrame(
        [(g, c, w) for g, m in table.items() for c, w in m.items()],
        "genre string, focus_category string, weight double")
    asked = songs.select(F.col("id").alias("query_id"), F.col("id").alias("song_id"))
    got = listed(P.similar(asked, songs, 6, genre_weights=weights))
    for r in rows:
        assert got.get(r[0], []) == brute_similar(r[0], rows, 6, weights=table.get(r[3]))


def test_mert_is_decided_over_the_pool(spark):
    rows = [list(r) for r in catalogue(10)]
    for r in rows:
        r[8] = None if r[0] else [1.0, 0.0, 0.0, 0.0, 0.0]
        r[7] = [1.0] * 44
    songs = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    cand = spark.createDataFrame([(0, 1, 0.5, 1), (0, 2, 0.4, 2)],
                                 "query_id long, id long, similarity double, rank int")
    out = {r.id: r.similarity for r in R.fuse(cand, as_queries(songs).where("query_id = 0"), songs).collect()}
    assert out[1] == pytest.approx(0.8 * 0.5 + 0.2)  # nobody in the pool has the vector


def test_vibe_fallback_is_not_resorted(spark):
    rows = catalogue(50, 8, seed=3)
    by_id = {r[0]: r for r in rows}
    songs = spark.createDataFrame(rows, SCHEMA)
    seeds = [4, 5, 7, 4]
    sets = spark.createDataFrame([(1, seeds)], "query_id long, song_ids array<long>")
    got = listed(P.vibe(sets, songs, 12, per_seed=4, min_sim=-1.0))[1]
    scores, order = {}, []
    for s in seeds:
        for i, sim in brute_search(s, by_id[s][6], rows, 4):
            if i in seeds:
                continue
            if i not in scores:
                order.append(i)
            scores.setdefault(i, []).append(sim)
    want = sorted([(i, min(scores[i])) for i in order if len(scores[i]) >= 2], key=lambda x: -x[1])
    centre = np.mean([by_id[s][6] for s in seeds], axis=0)
    for i, s in brute_search(None, centre, rows, 12 + len(set(seeds))):
        if i not in seeds and i not in {w[0] for w in want} and len(want) < 12:
            want.append((i, s))
    assert got == [(i, round(s, 9)) for i, s in brute_dedup(want, by_id)[:12]]


def test_blend_matches_brute_force(spark):
    rows = catalogue(60, seed=5)
    by_id = {r[0]: r for r in rows}
    songs = spark.createDataFrame(rows, SCHEMA)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4)], "query_id long, song_a long, song_b long")
    got = listed(P.blend(pairs, songs, 5, min_sim=-1.0))
    for qid, a, b in ((1, 1, 2), (2, 3, 4)):
        mid = (np.array(by_id[a][6]) + np.array(by_id[b][6])) / 2
        pool = [(i, s) for i, s in brute_search(None, mid, rows, 17) if i not in (a, b)]
        if by_id[a][7] and by_id[b][7]:
            hc = (np.array(by_id[a][7]) + np.array(by_id[b][7])) / 2
            pool = sorted([(i, 0.8 * s + 0.2 * cos(hc, by_id[i][7]) if by_id[i][7] else s)
                           for i, s in pool], key=lambda x: -round(x[1], 12))
        assert got[qid] == [(i, round(s, 9)) for i, s in brute_dedup(pool, by_id)[:5]]


def test_journeys_match_brute_force(spark):
    rows = catalogue(40, seed=9)
    songs = spark.createDataFrame(rows, SCHEMA)
    starts = spark.createDataFrame([(1, 2), (2, 7), (3, 20)], "journey_id long, song_id long")
    path = P.journeys(starts, songs, 3, min_sim=-1.0)
    got = {}
    for r in path.orderBy("journey_id", "step").collect():
        got.setdefault(r.journey_id, []).append(r.song_id)
    for jid, start in ((1, 2), (2, 7), (3, 20)):
        walk = [start]
        for _ in range(3):
            nxt = brute_similar(walk[-1], rows, 5, exclude=set(walk), floor=-1.0)
            walk.append(nxt[0][0])
        assert got[jid] == walk
    stats = {r.journey_id: r for r in P.journey_stats(path, songs).collect()}
    assert stats[1].steps == 4 and stats[1].distance > 1


# ----------------------------------------------------------------------- plans

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_catalogue_in_place(spark):
    songs = spark.createDataFrame(catalogue(), SCHEMA)
    plan = plan_of(S.top_k(as_queries(songs), songs, 5, exclude="query_id"))
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
    assert plan.index("MapInArrow") > plan.index("Exchange")  # no shuffle below the search


def test_one_exchange_after_fusion(spark):
    songs = spark.createDataFrame(catalogue(), SCHEMA)
    asked = songs.select(F.col("id").alias("query_id"), F.col("id").alias("song_id"))
    plan = plan_of(P.similar(asked, songs, 5))
    tail = plan[:plan.index("Join")]
    assert "Exchange" not in tail and "FlatMapGroupsInArrow" in tail


@pytest.mark.parametrize("strategy", ["scan", "cells"])
def test_vectors_of_other_lengths_are_not_searched(spark, strategy):
    songs = spark.createDataFrame(
        [(1, [1.0, 0.0], 1.0), (2, [1.0], 1.0), (3, [1.0, 0.0, 5.0], 1.0), (4, [0.0, float("nan")], 1.0), (5, [1.0, 1.0], 1.0),
         (6, None, 1.0)], "id long, learned array<double>, bpm double")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, vector array<double>")
    got = S.nearest(queries, songs, 5, strategy=strategy).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, 1), (1, 5)]
    assert {r.reason: r["count"] for r in S.rejected(songs, 2).collect()} == {"length": 2, "element": 1, "missing": 1}


def test_signals_of_one_scan(spark, monkeypatch):
    """Precision of several signals at once: rows of the searches one by one, from one read or a narrow copy."""
    import random

    from soundalike.operators import evaluate as E
    from soundalike.operators import search as SE
    rng = random.Random(5)
    rows = [(i, f"g{i % 3}" if i % 11 else None, [rng.gauss(0, 1) for _ in range(4)] if i % 7 else None,
             [rng.gauss(i % 3, 1) for _ in range(3 if i % 13 else 2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, genre string, learned array<double>, handcrafted_norm array<double>")
    signals = ("learned", "handcrafted")
    want = [E.precision_at_k(df, s, 5).first() for s in signals]
    want = sorted((r["signal"], round(r["precision"], 9), r["count"]) for r in want)

    def got():
        out = E.precision_of_signals(df, signals, 5).collect()
        return sorted((r["signal"], round(r["precision"], 9), r["count"]) for r in out)
    assert got() == want
    monkeypatch.setattr(SE, "MAX_SCAN_QUERIES", 10)
    assert got() == want
    none = E.precision_of_signals(df.limit(0), signals, 5).collect()
    assert sorted((r["signal"], r["precision"], r["count"]) for r in none) == [("handcrafted", None, 0), ("learned", None, 0)]


def test_a_query_leaves_the_cells_with_k_hits_once(spark, monkeypatch):
    """Hits of single cells and blocks are not shuffled, only the k best of a query."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)).astype("f4").astype(float)
    songs = spark.createDataFrame([(i, 100.0, x.tolist()) for i, x in enumerate(v)], "id long, bpm double, learned array<double>")
    moved, best = [], S.best_per_query

    def counted(hits, k):
        moved.append(hits.count())
        return best(hits, k)
    monkeypatch.setattr(S, "best_per_query", counted)
    asked = songs.select(F.col("id").alias("query_id"), F.col("learned").alias("vector"))
    got = S.nearest(asked, songs, 5, strategy="cells", n_pivots=6, block_rows=16).collect()
    assert max(moved) <= 300 * 5
    u = v / np.sqrt((v * v).sum(1))[:, None]
    scores = np.round(u @ u.T, 12)
    for i in range(300):
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == np.lexsort(
            (np.arange(300), -scores[i]))[:5].tolist()


@pytest.mark.parametrize("extra_rows", ["none", "id", "vector", "no id", "song without id"])
def test_ranks_of_cells_need_no_window(spark, extra_rows):
    """Hits leave a task in order; only repeated query ids, or null ids, have to be ranked anew."""
    rows = catalogue(50, 6, 4, copies=0.2)
    songs = spark.createDataFrame(rows, SCHEMA)
    asked = as_queries(songs).where("query_id <> 7").repartition(3)
    one = as_queries(songs).where("query_id = 7")
    more = {"none": one, "id": one.unionByName(one.withColumn("vector", F.reverse("vector"))),
            "vector": one.unionByName(one.withColumn("query_id", F.lit(900).cast("long"))),
            "no id": one.unionByName(one.withColumn("query_id", F.lit(None).cast("long"))), "song without id": one}
    asked = asked.unionByName(more[extra_rows].select(asked.columns))
    if extra_rows == "song without id":
        songs = songs.withColumn("id", F.when(F.col("id") != 9, F.col("id")))
    got = S.nearest(asked, songs, 5, strategy="cells", n_pivots=4, block_rows=16)
    assert ("row_number" in plan_of(got)) == (extra_rows in ("id", "no id", "song without id"))
    if extra_rows != "song without id":  # numpy and Spark sort a null id differently
        as_rows = lambda df: sorted(map(tuple, df.where("query_id is not null").collect()))
        same = [[c[:3] + c[4:] for c in as_rows(S.nearest(asked, songs, 5, strategy=s, **kw))] for s, kw in (
            ("scan", {}), ("cells", {"n_pivots": 4, "block_rows": 16}))]
        assert same[0] == same[1]


def test_block_keeps_k_a_query_whatever_comes(monkeypatch):
    """what a task holds is bounded by its queries, not by the rows that it reads."""
    monkeypatch.setattr(S, "PIECE", 512)
    rng = np.random.default_rng(6)
    q = rng.normal(size=(40, 4))
    best, held = S._Best(q, np.full(40, np.nan), 7), 0
    rows = rng.normal(size=(5000, 4))
    for a in range(0, 5000, 50):
        best.add(np.arange(a, a + 50), np.zeros(50), rows[a:a + 50], np.arange(40))
        held = max(held, best.n_fresh)
    best.cut()
    row, score, ids, _ = best.kept
    scores = np.round(q @ rows.T, 12)
    for i in range(40):
        assert ids[row == i].tolist() == np.lexsort((np.arange(5000), -scores[i]))[:7].tolist()
    assert held <= 512


def test_number_of_blocks_does_not_grow_with_the_table():
    """Each block gets a copy of the catalogue; 6 GB of songs with 300 hits need no more blocks than 0.1 GB."""
    assert [-(-n // S._block_size(n, 300, 64, 12)) for n in (10_256, 102_564, 615_000)] == [24, 24, 24]


def test_rough_scores_leave_out_no_hit(monkeypatch):
    """Vectors that single precision cannot tell apart come in the order of their exact scores."""
    monkeypatch.setattr(S, "PIECE", 256)
    rng = np.random.default_rng(9)
    q = S._units(rng.normal(size=(30, 8)))[0]
    rows = S._units(np.repeat(q, 20, axis=0) + rng.normal(size=(600, 8)) * 1e-5)[0][rng.permutation(600)]
    best = S._Best(q, np.full(30, np.nan), 7)
    for a in range(0, 600, 60):
        best.add(np.arange(a, a + 60), np.zeros(60), rows[a:a + 60], np.arange(30))
    best.cut()
    row, score, ids, _ = best.kept
    assert best.q4.dtype == np.float32 and score.dtype == np.float64
    exact = np.round(np.einsum("id,jd->ij", q, rows), S.DIGITS)
    for i in range(30):
        assert ids[row == i].tolist() == np.lexsort((np.arange(600), -exact[i]))[:7].tolist()


def test_packed_vectors_are_the_same(spark):
    """Vectors of the fusion travel in four bytes an element only where that is exact."""
    values = [[0.5, -1.25], [0.1, 0.5], [], None, [None, 2.0], [float("inf"), float("nan")]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    out = df.select("i", "v", packed("v").alias("p")).select("i", "v", "p", unpacked("p").alias("u")).orderBy("i").collect()
    assert [repr(r.u) for r in out] == [repr(r.v) for r in out]
    assert [r.p.narrow is not None for r in out] == [True, False, True, False, True, True]


def test_decoded_codes_are_the_sum_of_look_ups():
    """F1, F2: short lists score what codes stand for by one product; the sums of look-ups are the same."""
    rng = np.random.default_rng(8)
    units = S._units(rng.normal(size=(400, 12)))[0]
    cuts = np.linspace(0, 12, 5).astype(int)
    book = A.Codebook(units[:9], [rng.normal(size=(20, 3)) / 9 for _ in range(4)], cuts)
    cell, codes = book.code(units)
    want = A._scores(book.tables(units[:30]).astype("f4"), codes) + (units[:30] @ book.centroids.T)[:, cell]
    assert np.allclose(units[:30] @ book.decoded(cell, codes).T, want, atol=1e-5)


def test_broadcast_codebook_needs_no_class(spark, monkeypatch):
    """what is broadcast for an approximate search is arrays, so executors need no module for it."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), send(self, value))[1])
    songs = spark.createDataFrame(catalogue(200, copies=0.0), SCHEMA)
    asked = songs.select(F.col("id").alias("query_id"), F.col("learned").alias("vector"))
    assert A.nearest(asked, songs, 5).count() == 1000
    assert sent and not [v for v in sent if isinstance(v, A.Codebook)]


def moved(df):
    """Bytes that the exchanges of a query were given, after it has run."""
    df.collect()

    def total(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return total(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return total(plan.plan())
        own = plan.metrics().get("dataSize").get().value() if plan.nodeName() == "Exchange" else 0
        return own + sum(total(plan.children().apply(i)) for i in range(plan.children().size()))

    return total(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("focus, share", [("rhythm", 0.5), ("harmony", 0.7)])
def test_only_the_focused_elements_move(spark, focus, share):
    """With one focus for all queries the other elements of the handcrafted vectors are not shuffled."""
    rows = [r for r in catalogue(40) if r[7]]
    songs = spark.createDataFrame(rows, SCHEMA)
    cand = spark.createDataFrame([(a[0], b[0], 0.5, n + 1) for a in rows for n, b in enumerate(rows)],
                                 "query_id long, id long, similarity double, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, part = (moved(R.fuse(cand, as_queries(songs), songs, focus=f, mert=None)) for f in (None, focus))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < part < share * whole


@pytest.mark.parametrize("focus", FOCUS)
def test_part_of_a_category_scores_as_the_whole_vector(spark, focus):
    """The part that moves gives the very products of whole vectors, also for odd ones."""
    rng = np.random.default_rng(3)
    full = lambda **odd: [odd.get(f"_{i}", float(x)) for i, x in enumerate(rng.normal(size=44))]
    nan, inf = float("nan"), float("inf")
    values = [full(), full(), full(_5=None), full(_30=None), full(_40=None), full(_43=None), full(_27=nan), full(_40=nan),
              full(_40=None, _1=nan), full(_41=inf), full(_2=1e200), [0.0] * 44, full()[:30], full()[:42], full() + [7.0, 1.0],
              [], None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v array<double>")
    only = {name: F.when(F.lit(name == focus), 1.0).otherwise(0.0) for name in FOCUS}
    short = {focus: range(len(FOCUS[focus]))}
    sides = df.select("i", "v", category_part("v", focus).alias("p")).localCheckpoint()
    both = sides.toDF("qi", "qv", "qp").crossJoin(sides).select(
        "qi", "i", (F.size("v") > 0).alias("has"), (F.size("p") > 0).alias("has_part"),
        dot(category_units("qv", FOCUS, only), category_units("v")).alias("whole"),
        dot(category_units("qp", short), category_units("p", short)).alias("part")).collect()
    for r in both:
        assert bool(r.has) == bool(r.has_part)
        if r.has and len(values[r.qi] or []):
            assert repr(r.part) == repr(r.whole) or r.part == r.whole, (r.qi, r.i)


def test_vibe_plans_hold_one_search_and_no_seed_sets(spark):
    """what the steps of both searches share is worked out once, so the driver plans and broadcasts it once."""
    songs = spark.createDataFrame(catalogue(40), SCHEMA)
    sets = songs.where("id < 12").select(F.col("id").alias("query_id"), F.array("id", F.col("id") + 1).alias("song_ids"))
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b
    sets = sets.mapInArrow(count, sets.schema)
    got = P.vibe(sets, songs, 8, per_seed=6, min_sim=-1.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and got.count() > 0
    assert counted.value == 12


def test_seed_sets_of_repeated_and_missing_ids(spark):
    """sets of neighbouring ids are found without a join, so no ids are broadcast; one for each row of the first id."""
    from soundalike.plans.retrieval_queries import _seed_sets
    ids = [1, 2, 3, 4, 4, 5, 7, 8, 10, 11, 11, 12, None, -1, 0]
    sets = _seed_sets(spark.createDataFrame([(i,) for i in ids], "id long"))
    want = [(i, [i, i + 1, i + 2]) for i in ids if i is not None and {i + 1, i + 2} <= set(ids)]
    assert sorted((r.query_id, r.song_ids) for r in sets.collect()) == sorted(want) and (10, [10, 11, 12]) in want
    assert "Join" not in sets._jdf.queryExecution().optimizedPlan().toString()
