"""Hard negatives, ranked lexical search and the Jaccard join against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from soundalike.llm import hard_negatives as H
from soundalike.llm import jaccard_join as J
from soundalike.llm import lexical_search as L
from soundalike.llm.common import hash_blocks
from soundalike.llm.kernels import Best



def prose(seed, n):
    r = random.Random(seed)
    words = ["ath", "bren", "colt", "dun", "erst", "fal", "gorm", "hesk", "inth", "jor", "kell", "lum"]
    return ["".join(r.choices(words, k=2)) for _ in range(n)]


# ------------------------------------------------------------------- hard negatives

VECTORS = "id long, label int, vec array<double>, `odd name` string, score double, rank int"


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95, scale=1.0):
    usable = []
    for r in rows:
        if r[1] is None or r[2] is None or any(x is None or not math.isfinite(x) for x in r[2]):
            continue
        usable.append((r[0], r[1], tuple(math.floor(scale * x) for x in r[2])))
    out = []
    order = lambda s, i: (-s, i is None, i or 0)
    for a in {u for u in usable if is_anchor(u[0])}:
        others = [(sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in usable
                  if len(b[2]) == len(a[2]) and b[0] != a[0]]
        best = sorted((x for x in others if x[2] == a[1]), key=lambda x: order(*x[:2]))[:positives]
        for score, i, _ in best:
            fit = [x for x in others if x[2] != a[1] and low * score <= 100 * x[0] <= high * score]
            for n, x in enumerate(sorted(fit, key=lambda x: order(*x[:2]))[:negatives]):
                out.append((a[0], i, n + 1, x[1], score, x[0]))
    return sorted(out, key=repr)


def mined(df, **more):
    return sorted(map(tuple, H.mine(df, F.col("id") % 5 == 0, **more).collect()), key=repr)


def vector_rows(n=400, dim=20, seed=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(4, dim))
    return [(i, int(i % 6 % 4), (r.normal(size=dim) + 2 * middle[i % 4]).round(3).tolist(), None, None, None)
            for i in range(n)]


def test_negatives_match_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = mined(df, scale=64.0)
    assert got == plain_negatives(rows, lambda i: i % 5 == 0, scale=64.0) and len(got) > 200


def test_negatives_of_awkward_rows(spark):
    rows = vector_rows(60, 6, 1) + [
        (100, None, [1.0] * 6, None, None, None), (105, 1, None, None, None, None), (None, 1, [2.0] * 6, "x", 1.0, 1),
        (110, 1, [1.0, None] * 3, None, None, None), (115, 2, [float("nan")] * 6, None, None, None),
        (120, 2, [float("inf")] * 6, None, None, None), (125, 2, [1.0, 2.0], None, None, None), (126, 2, [1.0, 1.0], None, None, None),
        (127, 3, [1.0, 1.0], None, None, None), (130, 1, [], None, None, None), (131, 1, [], None, None, None), (132, 2, [], None, None, None),
        (135, 0, [0.0] * 6, None, None, None), (136, 0, [0.0] * 6, None, None, None), (None, 2, [3.0] * 6, None, None, None)]
    rows += [rows[3], rows[3], rows[5], rows[5]]  # repeated rows, an anchor among them
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert mined(df) == plain_negatives(rows, lambda i: i is not None and i % 5 == 0)
    assert mined(df.limit(0)) == []


def test_large_scores_are_exact(spark):
    rows = [(i, i % 2, [float(10 ** 7 + i), float(3 * 10 ** 7 - i)], None, None, None) for i in range(30)]
    assert mined(spark.createDataFrame(rows, VECTORS), low=0, high=100) == plain_negatives(
        rows, lambda i: i % 5 == 0, low=0, high=100)


def test_anchor_blocks_do_not_change_results(spark, monkeypatch):
    rows = vector_rows(120)
    df = spark.createDataFrame(rows, VECTORS)
    whole = mined(df)
    monkeypatch.setattr(H, "BLOCK_BYTES", 1000)
    parts = hash_blocks(df.where("id % 5 = 0"), ("id",), F.lit(224), 1000)
    assert parts > 4 and mined(df) == whole


def test_summaries_bound_every_score():
    r = np.random.default_rng(3)
    a, b = np.floor(50 * r.normal(size=(40, 37))), np.floor(50 * r.normal(size=(60, 37)))
    exact = a @ b.T
    width = []
    for level in range(len(H.levels(37))):
        mean, spread = H._bounds(level, 37, H.summaries(a).astype("f8"), H.summaries(b).astype("f8"))
        assert (exact <= mean + spread + 1).all() and (exact >= mean - spread - 1).all()
        width.append(spread.mean())
    assert width == sorted(width, reverse=True)  # finer segments bound better


def test_summaries_leave_few_pairs():
    """Vectors with smooth courses are told apart by their segments; only survivors are scored."""
    r = np.random.default_rng(4)
    course = np.repeat(r.normal(size=(600, 16)), 4, axis=1)
    v = np.floor(100 * (course + 0.05 * r.normal(size=course.shape)))
    block = H.Block(np.arange(20), np.arange(20), np.zeros(20, "i8"), v[:20])
    scores = v[:20] @ v.T
    low = np.sort(scores, axis=1)[:, -6].astype("i8")
    rows, cols, found = H.surviving(block, np.arange(20), v, H.summaries(v), np.ones((20, 600), bool), low,
                                    np.full(20, H.NO_ID))
    assert sorted(zip(rows, cols)) == sorted(zip(*np.nonzero(scores >= low[:, None])))
    mean, spread = H._bounds(2, 64, block.summary, H.summaries(v).astype("f8"))
    assert (mean + spread >= low[:, None]).mean() < 0.05


def test_best_keeps_ties_by_id():
    best = Best(2, 3)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 5, 7, 1]), np.array([9, 3, 4, 8]))
    best.add(np.array([0, 0]), np.array([5, 5]), np.array([1, 2]))
    assert best.scores[0].tolist() == [7, 5, 5] and best.ids[0].tolist() == [4, 1, 2]
    assert best.ids[1].tolist() == [8, H.NO_ID, H.NO_ID]


# ------------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_rank(items, docs, k=10):
    docs = [(i, Counter(t), len(t)) for i, t in ((i, plain_terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, tf, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t in plain_terms(text) if t in tf)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, j + 1, f[3], -f[0]) for j, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def ranked(items, docs, **more):
    return sorted(map(tuple, L.rank(items, docs, **more).collect()), key=repr)


def test_terms():
    text = "Ab-c9_ÄÖ é x\x00y\tZZ q 日本、語 " + "z" * 30
    assert [w.decode() for words in L.terms_of(text.encode()) for w in words] == plain_terms(text)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 50)
    text = " ".join(prose(8, 400)) + " " + "q" * 300 + " end"
    assert [w.decode() for words in L.terms_of(text.encode()) for w in words] == plain_terms(text)


@pytest.mark.parametrize("postings", [300, 2_000_000])
def test_search_matches_brute_force(spark, awkward, awkward_rows, postings, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_POSTINGS", postings)
    items = [(1, "athbren coltdun The"), (2, None), (3, ""), (4, "no such terms here"), (5, "Short. SHORT short"),
             (6, " ".join(prose(1, 120))), (7, "日本語 äöü end"), (6, "gormhesk"), (None, "lumlum korr erstfal"),
             (1, "athbren coltdun The")]  # the last repeats the first
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, doc_id string, score int")
    assert ranked(df, awkward) == plain_rank(items, [(r[0], r[1]) for r in awkward_rows])
    assert ranked(df, awkward.limit(0)) == [] and ranked(df.limit(0), awkward) == []


def test_search_on_item_blocks(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = ranked(items, documents)
    monkeypatch.setattr(L, "ITEM_BYTES", 2000)
    assert ranked(items, documents) == whole
    assert whole == plain_rank([tuple(r) for r in items.select("item_id", "text").collect()],
                               [tuple(r) for r in documents.select("doc_id", "text").collect()])


def lists_of(seed, n_docs=3000, vocabulary=40):
    r = np.random.default_rng(seed)
    docs = [np.flatnonzero(r.random(vocabulary) < 0.3) for _ in range(n_docs)]
    sizes = np.array([len(d) for d in docs])
    times = r.integers(1, 9, sizes.sum())
    lengths = r.integers(20, 400, n_docs)
    return L.Lists(np.arange(n_docs), lengths, sizes, np.concatenate(docs), times, vocabulary, n_docs, int(lengths.sum()))


def test_reading_stops_early_and_strictly_below_the_kth():
    lists = lists_of(2)
    weight = np.arange(1, 41) * 100
    terms, once = np.array([3, 17, 38]), np.array([1, 2, 1])
    every, _ = lists.access(np.arange(3000), np.bincount(terms, weights=once * weight[terms], minlength=40).astype("i8"))
    want = np.lexsort((np.arange(3000), -every))[:10]
    asked = []
    access = lists.access
    lists.access = lambda docs, w: (asked.append(len(docs)), access(docs, w))[1]
    best = Best(1, 10)
    lists.search(0, terms, once, weight, best)
    assert best.ids[0].tolist() == want.tolist() and best.scores[0].tolist() == every[want].tolist()
    assert sum(asked) < 1500  # of 3,000 documents, some 2,000 of which hold a term
    # Ties at the k-th score come by id even where the larger id was met first.
    tied = L.Lists(np.array([7, 5, 3, 1]), np.full(4, 10), np.ones(4, "i8"), np.zeros(4, "i8"), np.ones(4, "i8"), 1, 4, 40)
    best = Best(1, 2)
    tied.search(0, np.array([0]), np.array([1]), np.array([5]), best)
    assert best.ids[0].tolist() == [1, 3]


# ---------------------------------------------------------------------- Jaccard join

def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_components(rows, percent=90):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted([(doc, len(sets[i]), least.get(top(i))) for i, (doc, _) in enumerate(rows)], key=repr)


def joined(df, **more):
    return sorted(map(tuple, J.join(df.select("*"), **more).collect()), key=repr)


def test_join_of_awkward_rows(awkward, awkward_rows, nothing):
    assert joined(awkward) == plain_components([(r[0], r[1]) for r in awkward_rows])
    assert joined(nothing) == []


def copies(seed, groups=12, each=20):
    """Groups of near copies around the threshold, with texts that share passages, and a chain."""
    r = random.Random(seed)
    rows, passage = [], prose(90 + seed, 60)
    for g in range(groups):
        body = prose(100 * seed + g, r.choice([12, 40, 90, 150, 400]))
        if g % 3 == 0:
            body = body + passage
        for _ in range(each):
            words = list(body)
            for _ in range(r.randint(0, max(1, len(words) // (24 if g % 4 == 1 else 50)))):
                words[r.randrange(len(words))] = r.choice(["alpha", "beta", "gamma", "The"])
            rows.append((len(rows) * 3 + 1, " ".join(words).upper() if r.random() < 0.1 else " ".join(words)))
    chain = prose(7, 100)
    for i in range(25):
        chain = chain[1:] + [f"link{i}"]
        rows.append((5000 - i, " ".join(chain)))
    return rows


@pytest.mark.parametrize("leaf", [J.LEAF, 6])
def test_join_matches_brute_force(spark, leaf, monkeypatch):
    """With small leaves, regions of document pivots are split again and again."""
    calls = []
    split = J.split
    monkeypatch.setattr(J, "split", lambda *a: (calls.append(a[-1]), split(*a))[1])
    if leaf < 10:
        monkeypatch.setattr(J, "PIVOTS", 3)
        monkeypatch.setattr(J, "GROUP_ROWS", 5)
    rows = copies(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = joined(df, leaf=leaf)
    assert got == plain_components(rows)
    assert 12 < len({r[2] for r in got}) < len(rows) - 60  # some linked, some not
    assert (len(calls) >= 1) == (leaf < 10)


def test_split_of_members_at_like_distances(spark, monkeypatch):
    """Near copies that are mostly not linked: most would go into the regions of most pivots, so regions stay whole."""
    monkeypatch.setattr(J, "PIVOTS", 8)
    stored, rows_of = J.stored, {}

    def counting(df, name):
        out = stored(df, name)
        rows_of.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(J, "stored", counting)
    r = random.Random(3)
    body, rows = [f"w{r.randrange(900)}" for _ in range(150)], []
    for i in range(80):
        words = list(body)
        for _ in range(r.choice([1, 2, 2, 3])):
            words[r.randrange(150)] = f"w{r.randrange(900)}"
        rows.append((i, " ".join(words)))
    got = joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), leaf=6)
    assert got == plain_components(rows)
    assert 1 < len({r[2] for r in got}) < len(rows)
    members = rows_of["jaccard-rest"][0]
    assert members > 6 and rows_of["jaccard-split"] and sum(rows_of["jaccard-split"]) <= 2 * members


def test_join_on_registered_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert joined(documents) == plain_components(rows)


@pytest.mark.parametrize("long", [10, 270, 1024])
def test_filters_lose_no_link(long, monkeypatch):
    monkeypatch.setattr(J, "LONG", long)
    r = random.Random(1)
    body = [w.lower() for w in prose(4, 300)]
    texts = []
    for k in range(0, 40, 2):
        words = list(body)
        for _ in range(k // 4):
            words[r.randrange(len(words))] = f"new{r.random()}"
        texts.append(" ".join(words[:300 - k]))
    counts = np.random.default_rng(0).integers(0, 90, J.COUNTERS + (1 << J.WORD_BITS))
    found, sizes, _, place = J.sets_of(texts, J.Order(counts))
    ends = np.cumsum(sizes)
    sets = [found[e - n:e] for e, n in zip(ends, sizes)]
    short = J.Shorts(pa.array([x.tobytes() for x in J.short_vectors(found, sizes)], pa.binary()))
    places = [place[e - n:e] for e, n in zip(ends, sizes)]
    some = 0
    for i in range(len(sets)):
        for j in range(i):
            if J.links(J.common(sets[i], sets[j]), sizes[i], sizes[j], 90):
                some += 1
                assert J.may_link(short, short, np.array([i]), np.array([j]), sizes[[i]], sizes[[j]], 90).all()
                assert set(J.first_shingles(sets[i], places[i], 90)) & set(J.first_shingles(sets[j], places[j], 90))
    assert some > 10
    shared = J.common_matrix(sets, sets)
    assert all(shared[i, j] == J.common(sets[i], sets[j]) for i in range(len(sets)) for j in range(len(sets)))


def test_arrow_lists_of_no_rows():
    flat, sizes = H._lists(pa.array([None, [1.0, None], []], pa.list_(pa.float64())))
    assert sizes.tolist() == [-1, 2, 0] and np.isnan(flat[1])
