"""Exact and near copies, mixing: contracts, plain versions, awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundalike.llm import exact_dedup as X
from soundalike.llm import mixing as M
from soundalike.llm import near_dedup as N
from soundalike.llm.components import components

GAP = re.compile(r"[\x20\x09-\x0D]")


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256(GAP.sub("", text or "").encode()).hexdigest()].append((-len(text or ""), i is None, i or 0, i))
    return groups


def test_exact_decisions(awkward, awkward_rows):
    got = X.decisions(awkward).collect()
    groups = plain_groups([(r[0], r[1]) for r in awkward_rows])
    assert len(got) == len(awkward_rows)
    for r in got:
        group = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(group)[3], len(group))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(groups.keys())  # one of each, repeated rows included


def test_exact_drop_keeps_columns(awkward, awkward_rows, nothing):
    out = X.drop_copies(awkward)
    assert out.columns == awkward.columns
    groups = plain_groups([(r[0], r[1]) for r in awkward_rows])
    assert sorted(map(repr, (min(g)[3] for g in groups.values()))) == sorted(repr(r.doc_id) for r in out.collect())
    assert X.drop_copies(nothing).count() == 0 and X.decisions(nothing).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    rows = spark.range(4000).select(F.xxhash64(F.when(F.col("id") < 100, F.col("id") % 50).otherwise(F.col("id"))).alias("h"))
    bloom, blocks = X.repeat_filter(rows, "h", 4000)
    marked = X.maybe_repeated(rows, "h", bloom, blocks, "again").groupBy("h").agg(
        F.count("*").alias("n"), F.max("again").alias("again")).collect()
    assert all(r.again for r in marked if r.n > 1)
    assert sum(r.again for r in marked if r.n == 1) < 400


def test_exact_plan_is_native(awkward):
    for df in (X.decisions(awkward), X.drop_copies(awkward), M.decisions(awkward), M.mix(awkward)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------------- mixing

def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Resharing of the excess until none is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    rest = total
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 200, "c": 3000}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 100000, "c": 7, None: 50},
    {"x": 3, "y": 3, "z": 3, "zz": 900}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    want = plain_targets(sizes)
    got = {r.source: r.target for r in M.source_targets(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix(documents):
    got = M.decisions(documents).toPandas()
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    assert all(got["size"] == [len((texts[i] or "").split()) for i in got.doc_id])
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((sums.taken - sums.target).abs() < sums.most).all()
    wanted = got.target / got.source_size
    assert ((got.copies - wanted).abs() < 1).all()  # the whole part or one more
    again = M.decisions(documents.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    assert M.mix(documents).count() == got.copies.sum()


def test_mix_is_unbiased(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(120)],
                                 "doc_id long, text string, source string")
    runs = [M.decisions(docs, seed=s).select("doc_id", "copies", "target", "source_size").toPandas() for s in range(0, 200, 20)]
    mean = sum(r.sort_values("doc_id").copies.values for r in runs) / len(runs)
    want = (runs[0].sort_values("doc_id").target / runs[0].sort_values("doc_id").source_size).values
    assert abs((mean - want).mean()) < 0.02 and np.abs(mean - want).max() < 0.7


def test_mix_awkward(awkward, awkward_rows, nothing):
    got = M.decisions(awkward).collect()
    assert len(got) == len(awkward_rows)
    assert all(r.taken == 0 for r in got if r.doc_id in (4, 5, 6))
    out = M.mix(awkward)
    assert out.columns == awkward.columns and out.count() == sum(r.copies for r in got)
    assert M.decisions(nothing).count() == 0 and M.mix(nothing).count() == 0


# --------------------------------------------------------------------- near copies

def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_against_brute_force(documents):
    got = {r.doc_id: r.class_id for r in N.decisions(documents).collect()}
    rows = documents.select("doc_id", "text").collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert got[a] == got[b], (a, b)
    members = defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    for c, ids in members.items():
        assert c == min(ids)
        for i in ids:  # nobody is in a class without a partner that is close
            assert len(ids) == 1 or max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in ids if j != i) > 0.7


def test_near_awkward(awkward, nothing):
    got = N.decisions(awkward).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == awkward.count()
    assert by_id[2].class_id == by_id[3].class_id == 1 and by_id[1].kept and not by_id[2].kept
    assert [by_id[i].class_size for i in (4, 5, 6)] == [1, 1, 1]
    assert by_id[8].class_id == 7
    out = N.drop_near_copies(awkward)
    assert out.columns == awkward.columns
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(r.doc_id) for r in got if r.kept)
    assert N.decisions(nothing).count() == 0


def test_block_kernel_equals_pairwise():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(40):
        h = np.unique(rng.integers(0, 60, 45).astype("u8"))
        v = np.zeros(len(h), N.ENTRY)
        v["h"], v["n"] = h * np.uint64(7919), rng.integers(1, 4, len(h))
        v["w"] = 1 + (h % np.uint64(5)) / 5
        vectors.append(v)
    vectors += vectors[:5]
    old, N.COLUMNS = N.COLUMNS, 16
    try:
        hit = N.linked(vectors[:20], vectors[20:])
    finally:
        N.COLUMNS = old
    want = [[N.similar(a, b) >= N.THRESHOLD for b in vectors[20:]] for a in vectors[:20]]
    assert hit.tolist() == want and hit.any()


def test_repeated_passages_have_candidates(spark):
    """One side repeats 200 of 600 words 15 times more: only the plain similarity links the pair."""
    rows = []
    for k in range(40):
        rng = np.random.default_rng(k)
        body = [f"w{x}" for x in rng.integers(0, 5000, 600)]
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(body[:400] + body[200:400] * 15 + body[400:]))]
    got = {r.doc_id: r.class_id for r in N.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(40)) >= 38


def test_plain_samples_estimate_plain_similarity():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(30):
        h = np.sort(rng.integers(0, 2**63, 500).astype("u8"))
        s = N.plain_samples(np.concatenate((h[:450], h[50:])), np.array([450, 450]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400).astype("u8")
    h.sort()
    a, b = np.arange(0, 300), np.arange(60, 400)
    w = rng.choice([1.0, 1.5, 2.0], 400)
    s = N.samples(np.concatenate((h[a], h[b])), np.concatenate((w[a], w[b])), np.array([300, 340]))
    want = w[60:300].sum() / w.sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.18


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 7), (30, 31), (31, 30), (5, 5)]
    edges += [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4, 5)} == {1} and {got[i] for i in (7, 8, 9, 20)} == {7}
    assert got[31] == 30 and {got[100 + i] for i in range(41)} == {100}
