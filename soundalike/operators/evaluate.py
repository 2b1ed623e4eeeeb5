"""Retrieval quality and structure of the vector space (inventory E7-E9, E13-E20, E22-E24, G8, H5)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.functions.vectors import cosine, unit
from soundalike.operators.search import nearest, nearest_by_signal
from soundalike.session import cut

# Edges of the similarity histogram.
HISTOGRAM_EDGES = (0.8, 0.85, 0.9, 0.92, 0.94, 0.96, 0.98, 1.0)
NORM_FLOOR = 1e-10


# ------------------------------------------------------------------ precision at k

def signal_vector(signal: str, learned: str = "learned", handcrafted: str = "handcrafted_norm",
                  share: float = 0.8) -> Column:
    """The vector whose cosine is the signal.

    The fused signal ``share*cos(a) + (1-share)*cos(b)`` is the cosine of the two
    unit vectors laid end to end, scaled by the roots of their shares; so one
    search serves every signal.
    """
    if signal == "learned":
        return F.col(learned)
    if signal == "handcrafted":
        return F.col(handcrafted)
    if signal == "fused":
        a, b = float(np.sqrt(share)), float(np.sqrt(1 - share))
        return F.concat(F.transform(unit(learned, NORM_FLOOR), lambda x: x * a),
                        F.transform(unit(handcrafted, NORM_FLOOR), lambda x: x * b))
    raise ValueError(f"unknown signal {signal}")


def genre_hits(songs: DataFrame, signal: str = "fused", k: int = 10, **search) -> DataFrame:
    """Per labelled song the share of its ``k`` nearest other songs with its genre."""
    rows = songs.where(F.col("genre").isNotNull()).select(
        "id", "genre", signal_vector(signal).alias("v"), F.lit(0.0).alias("bpm"))
    queries = rows.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    near = nearest(queries, rows, k + 1, vec="v", **search)
    w = Window.partitionBy("query_id").orderBy("rank")
    near = (near.where(F.col("id") != F.col("query_id"))
            .withColumn("n", F.row_number().over(w)).where(F.col("n") <= k))
    own = rows.select(F.col("id").alias("query_id"), F.col("genre").alias("own"))
    hits = (near.join(rows.select("id", "genre"), "id").join(own, "query_id")
            .groupBy("query_id").agg(
                (F.count_if(F.col("genre") == F.col("own")) / k).alias("precision")))
    return own.select("query_id", F.col("own").alias("genre")).join(hits, "query_id", "left").select(
        "query_id", "genre", F.coalesce("precision", F.lit(0.0)).alias("precision"))


def precision_at_k(songs: DataFrame, signal: str = "fused", k: int = 10, by: str | None = None,
                   **search) -> DataFrame:
    """E7 (``by=None``) and E8 (``by="genre"``, genres of one song are left out)."""
    hits = genre_hits(songs, signal, k, **search)
    scores = (F.avg("precision").alias("precision"), F.count("*").alias("count"))
    if by is None:
        return hits.agg(*scores).select(F.lit(signal).alias("signal"), "precision", "count")
    return hits.groupBy(by).agg(*scores).where(F.col("count") >= 2)


def precision_of_signals(songs: DataFrame, signals: Sequence[str] = ("learned", "handcrafted", "fused"),
                         k: int = 10) -> DataFrame:
    """E7 for several signals side by side (``signal, precision, count``): one search that reads the songs once."""
    rows = songs.where(F.col("genre").isNotNull()).select(
        "id", "genre", F.lit(0.0).alias("bpm"), *[signal_vector(s).alias(s) for s in signals])
    near = nearest_by_signal(rows, k + 1, list(signals)).where(F.col("id") != F.col("query_id"))
    w = Window.partitionBy("signal", "query_id").orderBy("rank")
    near = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    genres = rows.select("id", "genre")
    own = genres.select(F.col("id").alias("query_id"), F.col("genre").alias("own"))
    hits = near.join(genres, "id").join(own, "query_id").groupBy("signal").agg(
        F.count_if(F.col("genre") == F.col("own")).alias("hits"))
    total = genres.agg(F.count("*").alias("count")).select(
        "count", F.explode(F.array(*map(F.lit, signals))).alias("signal"))  # one row per signal
    return total.join(hits, "signal", "left").select("signal", F.when(F.col("count") > 0, F.coalesce(
        "hits", F.lit(0)) / k / F.col("count")).alias("precision"), "count")


def random_baseline(songs: DataFrame) -> DataFrame:
    """Expected precision of a random list, ``1 / number of genres``."""
    return (songs.where(F.col("genre").isNotNull()).select("genre").distinct()
            .agg((1 / F.count("*")).alias("baseline")))


def verdict(precision: DataFrame, gate: float = 0.5) -> DataFrame:
    """Go / review against the gate."""
    return precision.withColumn(
        "verdict", F.when(F.col("precision") > gate, "go").otherwise("review"))


# ------------------------------------------------------------------------- sampling

def _shuffled(seed: int, c: str = "id") -> Column:
    return F.md5(F.concat_ws(":", F.col(c).cast("string"), F.lit(str(seed))))


def sample_songs(songs: DataFrame, n: int, seed: int = 42, vec: str = "learned") -> DataFrame:
    """Repeatable random sample of songs that have a vector (a bounded top-n, no full sort)."""
    return (songs.where(F.col(vec).isNotNull()).withColumn("_h", _shuffled(seed))
            .orderBy("_h", "id").limit(n).drop("_h"))


def stratified_sample(songs: DataFrame, n: int, by: str = "genre", seed: int = 42) -> DataFrame:
    """Up to ``n`` songs of every genre.  The per-group limit is taken map-side first."""
    w = Window.partitionBy(by).orderBy(_shuffled(seed), "id")
    return (songs.where(F.col(by).isNotNull())
            .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"))


def pair_sample(songs: DataFrame, n_pairs: int = 5000, n_songs: int = 3000, seed: int = 42,
                columns: Sequence[str] = ("learned",)) -> DataFrame:
    """Random pairs among a random sample of songs, no self pairs.

    Songs of the sample stand in random order; round ``r`` pairs every position
    with the one ``shift(r)`` further on.  At most ``n_songs`` rows are numbered.
    """
    every = Window.orderBy("_h", "id")
    sample = (songs.where(F.col(columns[0]).isNotNull()).withColumn("_h", _shuffled(seed))
              .select("_h", "id", *columns).orderBy("_h", "id").limit(n_songs)
              .withColumn("pos", F.row_number().over(every) - 1)
              .withColumn("m", F.count("*").over(Window.partitionBy())).drop("_h"))
    most = F.least(F.lit(n_pairs), (F.col("m") * (F.col("m") - 1) / 2).cast("long"))
    rounds = F.greatest(F.lit(1), F.ceil(F.lit(n_pairs) / F.col("m")).cast("int"))
    shift = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("r").cast("string"), F.lit(str(seed)))),
                               1, 8), 16, 10).cast("long")
    left = (sample.where(F.col("m") > 1)
            .withColumn("r", F.explode(F.sequence(F.lit(1), rounds)))
            .where((F.col("r") - 1) * F.col("m") + F.col("pos") < most)
            .withColumn("other", (F.col("pos") + 1 + shift % (F.col("m") - 1)) % F.col("m")))
    right = sample.select(F.col("pos").alias("other"), F.col("id").alias("id_b"),
                          *[F.col(x).alias(f"{x}_b") for x in columns])
    return left.join(right, "other").select(
        F.col("id").alias("id_a"), "id_b", *[F.col(x).alias(f"{x}_a") for x in columns],
        *[f"{x}_b" for x in columns])


#: Rows of one group when rings of songs are walked.
RING_SLICE = 100_000


def song_pairs(songs: DataFrame, rounds: int = 10, buckets: int = 64, seed: int = 42,
               columns: Sequence[str] = ("learned",), slice_rows: int = RING_SLICE) -> DataFrame:
    """E13 over all songs: every song meets ``rounds`` random others, whatever the size of the table.

    In each round songs are dealt to ``buckets`` rings by hash, and each is paired with the next one of its ring in
    hash order, the last with the first.  Rings are walked in slices of the hash range of about ``slice_rows``
    songs, as many as the table needs; the last song of a slice meets the first of the next slice, found among
    one narrow row per slice.  Only ids and hashes are sorted; vectors are joined to the pairs.
    """
    have = songs.where(F.col(columns[0]).isNotNull())
    slices = -(-have.count() // (buckets * slice_rows)) or 1
    dealt = have.select("id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn(
        "h", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.col("r").cast("string"))))
    bucket = F.conv(F.substring("h", 1, 4), 16, 10).cast("long") % buckets
    part = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * slices, 32)  # grows with the hash
    dealt = dealt.select("id", "r", "h", bucket.alias("bucket"), part.alias("part"))
    ring, place = ["r", "bucket"], ["r", "bucket", "part"]
    inside = Window.partitionBy(*place).orderBy("h", "id")
    walked = dealt.select(*place, F.col("id").alias("id_a"), F.lead("id").over(inside).alias("id_b"))
    heads = dealt.groupBy(*place).agg(F.min_by("id", F.struct("h", "id")).alias("head"))
    along = Window.partitionBy(*ring).orderBy("part")
    first = F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    follow = heads.select(*place, F.coalesce(F.lead("head").over(along), first).alias("id_b"))
    ends = walked.where(F.col("id_b").isNull()).drop("id_b").join(follow, place)
    pairs = walked.where(F.col("id_b").isNotNull()).unionByName(ends).select("id_a", "id_b").where("id_a <> id_b")
    for side in "ab":
        pairs = pairs.join(have.select(F.col("id").alias(f"id_{side}"), *[
            F.col(x).alias(f"{x}_{side}") for x in columns]), f"id_{side}")
    return pairs


def pair_similarities(pairs: DataFrame, columns: Sequence[str] = ("learned",)) -> DataFrame:
    return pairs.select("id_a", "id_b", *[
        cosine(f"{x}_a", f"{x}_b").alias(f"sim_{x}") for x in columns])


# ---------------------------------------------------------------------- description

PROFILE = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
#: Accuracy of the quantile sketch: ranks are off by one in so many rows at most.
SKETCH = 10_000


def percentiles(df: DataFrame, c: str, shares: Sequence[float]) -> list[float | None]:
    """Exact, interpolated percentiles of any number of rows, whatever their spread.

    A quantile sketch gives two values around each wanted rank, which lie a few ten-thousandths of the rows apart.
    Exact counts up to these say whether they hold the rank (if not, they are moved apart); then only the
    different values between them are sorted.
    """
    held = cut(df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("v")))
    n = held.count()
    if not n:
        return [None] * len(shares)
    ranks = [(n - 1) * p for p in shares]
    wanted = sorted({int(k) for r in ranks for k in (np.floor(r), np.ceil(r))})
    found: dict[int, tuple[float, float, int]] = {}
    slack = 2 / SKETCH
    while len(found) < len(wanted):
        open_ = [k for k in wanted if k not in found]
        places = [min(1.0, max(0.0, (k + 0.5) / n + d)) for k in open_ for d in (-slack, slack)]
        edge = held.agg(F.percentile_approx("v", places, SKETCH)).first()[0]
        sides = [(k, edge[2 * i], edge[2 * i + 1]) for i, k in enumerate(open_)]
        counts = held.agg(*[x for _, low, high in sides for x in (
            F.count(F.when(F.col("v") < low, 1)), F.count(F.when(F.col("v") <= high, 1)))]).first()
        for i, (k, low, high) in enumerate(sides):
            if counts[2 * i] <= k < counts[2 * i + 1]:
                found[k] = (low, high, counts[2 * i])
        slack *= 4
    asked = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(low).alias("low"), F.lit(high).alias("high"),
                               F.lit(below).cast("long").alias("below")) for k, (low, high, below) in found.items()])
    near = held.select("v", F.explode(F.filter(asked, lambda x: F.col("v").between(x["low"], x["high"]))).alias("x")).select(
        "v", "x.k", "x.below")
    ties = near.groupBy("k", "below", "v").count()
    upto = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ties.withColumn("end", F.col("below") + F.sum("count").over(upto))
    hit = ranked.where((F.col("k") < F.col("end")) & (F.col("k") >= F.col("end") - F.col("count")))
    value = {r["k"]: r["v"] for r in hit.select("k", "v").collect()}
    return [float(value[int(np.floor(r))] + (r - np.floor(r)) * (value[int(np.ceil(r))] - value[int(np.floor(r))]))
            for r in ranks]


def similarity_profile(sims: DataFrame, c: str = "sim_learned") -> DataFrame:
    """Spread of similarities, of all rows; percentiles are exact and interpolated."""
    held = cut(sims.select(c))
    found = percentiles(held, c, list(PROFILE.values()))
    return held.agg(
        F.count(c).alias("pairs"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max")).select(
        "*", *[F.lit(x).cast("double").alias(n) for n, x in zip(PROFILE, found)])


def histogram(df: DataFrame, c: str, edges: Sequence[float] = HISTOGRAM_EDGES) -> DataFrame:
    """Counts per half-open bin, the last one closed; shares are of all rows."""
    last = len(edges) - 2
    bucket = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        upper = F.col(c) <= edges[i + 1] if i == last else F.col(c) < edges[i + 1]
        bucket = F.when((F.col(c) >= edges[i]) & upper, F.lit(i)).otherwise(bucket)
    counted = df.groupBy(bucket.alias("bin")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row per bin
    counted = counted.withColumn("share", F.col("count") / total).where(F.col("bin").isNotNull())
    bins = df.sparkSession.createDataFrame(
        [(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)],
        "bin int, lower double, upper double")
    return bins.join(counted, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.coalesce("share", F.lit(0.0)).alias("share"))


def pca_ratios(songs: DataFrame, vec: str = "learned", k: int | None = None) -> DataFrame:
    """Explained variance ratio of the components, all or the first ``k`` (``pc, ratio, cumulative``).

    Vectors are as long as the longest; others take no part.  No vectors, no rows.
    """
    have = songs.where(F.col(vec).isNotNull())
    width = have.agg(F.max(F.size(vec))).first()[0] or 0
    rows = []
    if width:
        data = have.where(F.size(vec) == width).select(array_to_vector(vec).alias("v"))
        model = PCA(k=min(k or width, width), inputCol="v", outputCol="p").fit(data)
        rows = [(i + 1, float(r)) for i, r in enumerate(model.explainedVariance)]
    out = songs.sparkSession.createDataFrame(rows, "pc int, ratio double")
    running = Window.orderBy("pc")  # at most k rows
    return out.withColumn("cumulative", F.sum("ratio").over(running))


def axis_ratios(songs: DataFrame, vec: str = "learned") -> DataFrame:
    """Share of the variance that each axis of the vectors has, the largest first (``pc, ratio, cumulative``)."""
    spread = songs.where(F.col(vec).isNotNull()).select(F.posexplode(vec).alias("axis", "v")).groupBy("axis").agg(
        F.var_pop("v").alias("v"))  # one row per axis
    order = Window.orderBy(F.desc("v"), "axis")
    total = F.sum("v").over(Window.partitionBy())
    return spread.select(F.row_number().over(order).alias("pc"), (F.col("v") / total).alias("ratio")).withColumn(
        "cumulative", F.sum("ratio").over(Window.orderBy("pc")))


def pca_profile(ratios: DataFrame) -> DataFrame:
    """First components, components for 90 and 95 %, effective dimension."""
    def reach(t: float) -> Column:
        return F.coalesce(F.min(F.when(F.col("cumulative") >= t, F.col("pc"))),
                          F.count("*") + 1).cast("long")
    return ratios.agg(
        F.max(F.when(F.col("pc") == 1, F.col("cumulative"))).alias("pc1"),
        F.max(F.when(F.col("pc") == 2, F.col("cumulative"))).alias("pc1_2"),
        reach(0.90).alias("pcs_90"), reach(0.95).alias("pcs_95"),
        F.exp(-F.sum(F.col("ratio") * F.log(F.col("ratio") + 1e-10))).alias("effective_dim"))


def plane(songs: DataFrame, label: str = "genre", vec: str = "learned") -> DataFrame:
    """All songs in the plane of their first two components: ``id, label, x, y``."""
    data = songs.where(F.col(vec).isNotNull()).select(
        "id", F.coalesce(label, F.lit("Unknown")).alias("label"), array_to_vector(vec).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(data).transform(data).withColumn("p", vector_to_array("p"))
    return p.select("id", "label", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def silhouette_of(points: DataFrame) -> DataFrame:
    """Silhouette on squared distances of all points (``label, x, y``).

    The mean squared distance of a point to a label follows from the label's count, sum and sum of squares, so
    two passes serve any number of points.  The sums of all labels, one small row each, go along with every point.
    """
    x, y = F.col("x"), F.col("y")
    per = points.groupBy("label").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                                      F.sum(x * x + y * y).alias("ss"))
    every = per.agg(F.collect_list(F.struct("label", "n", "sx", "sy", "ss")).alias("every"))
    own_label = F.col("label")

    def total(s: Column) -> Column:
        return (x * x + y * y) * s["n"] + s["ss"] - 2 * (x * s["sx"] + y * s["sy"])
    both = points.withColumn("every", every.scalar())
    own = F.element_at(F.filter("every", lambda s: s["label"] == own_label), 1)
    a = F.greatest(F.lit(0.0), total(own)) / F.greatest(own["n"] - 1, F.lit(1))
    b = F.array_min(F.transform(F.filter("every", lambda s: s["label"] != own_label),
                                lambda s: F.greatest(F.lit(0.0), total(s)) / s["n"]))
    top = F.greatest(a, b)
    s = F.when((own["n"] > 1) & b.isNotNull() & (top > 0), (b - a) / top).otherwise(0.0)
    out = both.select("label", s.alias("s")).agg(
        F.count("*").alias("rows"), F.count_distinct("label").alias("labels"), F.avg("s").alias("silhouette"))
    return _judged(out)


def _judged(out: DataFrame) -> DataFrame:
    return out.withColumn("verdict", F.when(F.col("silhouette") < 0.1, "not separated")
                          .when(F.col("silhouette") < 0.3, "weak").otherwise("clear"))


def silhouette(songs: DataFrame, label: str = "genre", vec: str = "learned") -> DataFrame:
    """Silhouette of labels in the plane of the first two components, over all songs."""
    return silhouette_of(plane(songs, label, vec))


def sample_silhouette(songs: DataFrame, max_rows: int, label: str = "genre", vec: str = "learned",
                      seed: int = 42) -> DataFrame:
    """E18 on a sample: Euclidean silhouette of labels in the plane of the first two components.

    The plane comes from all songs; the score from a sample of at most
    ``max_rows`` (that bound is what makes sharing the sample with every task
    safe).  Tasks compare their rows with the sample; no pair is emitted.
    """
    data = songs.where(F.col(vec).isNotNull()).select(
        "id", F.coalesce(label, F.lit("Unknown")).alias("label"), array_to_vector(vec).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(data)
    points = (model.transform(data).select("id", "label", vector_to_array("p").alias("p"))
              .withColumn("_h", _shuffled(seed)).orderBy("_h", "id").limit(max_rows))
    held = points.select("label", "p").toArrow()
    names, codes = np.unique(held.column("label").to_numpy(zero_copy_only=False)
                             if isinstance(held.column("label"), pa.Array)
                             else np.asarray(held.column("label").to_pylist()), return_inverse=True)
    xy = np.asarray(held.column("p").to_pylist(), dtype=float).reshape(len(codes), 2)
    shared = songs.sparkSession.sparkContext.broadcast((list(names), codes, xy))

    def score(batches):
        labels, code, pts = shared.value
        index = {n: i for i, n in enumerate(labels)}
        sizes = np.bincount(code, minlength=len(labels))
        one_hot = np.eye(len(labels))[code]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array([index[x] for x in batch.column("label").to_pylist()])
            p = np.asarray(batch.column("p").to_pylist(), dtype=float)
            dist = np.sqrt(((p[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2))
            sums = dist @ one_hot
            n_own = sizes[own]
            a = sums[np.arange(len(own)), own] / np.maximum(n_own - 1, 1)
            means = sums / sizes[None, :]
            means[np.arange(len(own)), own] = np.inf
            b = means.min(axis=1)
            top = np.maximum(a, b)
            s = np.where((n_own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(s)], names=["label", "s"])

    scored = points.select("label", "p").mapInArrow(score, "label string, s double")
    out = scored.agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels"),
                     F.avg("s").alias("silhouette"))
    return _judged(out)


def spearman(df: DataFrame, a: str, b: str) -> float:
    """Rank correlation; ranks come from a distributed sort, ties share their mean rank."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        array_to_vector(F.array(F.col(a).cast("double"), F.col(b).cast("double"))).alias("v"))
    return float(Correlation.corr(pairs, "v", "spearman").first()[0].toArray()[0, 1])


def compare_models(rho: float, std_new: float, std_old: float, effective_dim: float) -> dict:
    """Agreement band and the points for or against a new vector space."""
    if rho > 0.7:
        agreement = "strong"
    elif rho > 0.4:
        agreement = "moderate"
    else:
        agreement = "weak"
    return {
        "agreement": agreement,
        "better_spread": std_new > std_old * 1.2,
        "higher_dimension": effective_dim > 15,
        "complementary": rho < 0.5,
        "worse_spread": std_new <= std_old * 0.8,
    }


def compare_spaces(songs: DataFrame, new: str, old: str, rounds: int = 10, seed: int = 42) -> DataFrame:
    """One row that compares two vector spaces over all songs that have both."""
    both = songs.where(F.col(new).isNotNull() & F.col(old).isNotNull())
    sims = cut(pair_similarities(song_pairs(both, rounds, seed=seed, columns=(new, old)), (new, old)))
    rho = spearman(sims, f"sim_{new}", f"sim_{old}")
    spread = sims.agg(F.count("*").alias("n"), F.stddev_pop(f"sim_{new}").alias("a"),
                      F.stddev_pop(f"sim_{old}").alias("b")).first()
    dim = pca_profile(pca_ratios(both, new)).first()["effective_dim"]
    flags = compare_models(rho, spread["a"], spread["b"], dim)
    row = {"pairs": spread["n"], "rho": rho, "std_new": spread["a"], "std_old": spread["b"],
           "effective_dim": dim, **flags}
    return songs.sparkSession.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {t}" for k, t in zip(row, ("long", "double", "double", "double", "double", "string",
                                         "boolean", "boolean", "boolean", "boolean"))))


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """H5."""
    return a.select("id").intersect(b.select("id"))


def canary(pairs: DataFrame, songs: DataFrame, floor: float = 0.8, vec: str = "learned"
           ) -> DataFrame:
    """Known pairs (``id_a, id_b``) with their similarity and whether it is high enough."""
    a = songs.select(F.col("id").alias("id_a"), F.col(vec).alias("_a"))
    b = songs.select(F.col("id").alias("id_b"), F.col(vec).alias("_b"))
    scored = pairs.join(a, "id_a", "left").join(b, "id_b", "left").withColumn(
        "similarity", cosine("_a", "_b")).drop("_a", "_b")
    return scored.withColumn("healthy", F.coalesce(F.col("similarity") > floor, F.lit(False)))
