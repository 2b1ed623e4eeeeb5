"""Hard negatives of anchors by segment summary filtering.

A vector is cut into segments, 1, then 4, then 16 of them.  Of each segment its mean and its deviation (the length
of what remains after taking the mean away) are stored beside the vector.  For two vectors the product of the means
plus or minus the product of the deviations, summed over segments, bounds the inner product from above and below.
Bounds are refined level by level on what the coarser level leaves, and only the rest is scored exactly.

Anchors are taken in blocks of at most ``BLOCK_BYTES``, which are broadcast; the table stays where it is and is
scanned twice per block:

1. rows of an anchor's label against the score of its k-th best positive so far;
2. rows of other labels against the windows of scores that its positives give.

A task keeps the best rows of each anchor, so ``anchors x tasks x k`` narrow rows are shuffled and no pair is
emitted.  Labels are never a key of a shuffle: a label with a third of all rows is read where it lies.

Defined results: components become ``floor(scale * x)`` and scores are exact integers.  Rows with a null label, a
null vector, or a null or non-finite component take no part; neither do rows whose squared length leaves 62 bits.
Vectors are compared with vectors of the same length; empty vectors have the score 0.  Rows of the anchor's own id
are not "other rows".  Repeated rows count as often as they occur, anchors that are equal in id, label and vector
are answered once.  Null ids come last among ties.  An anchor without positives, or without rows in its windows,
gives no rows; neither do empty tables.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, hash_blocks, need, query, stored, table
from soundalike.llm.kernels import LEAST, NO_ID, Best
from soundalike.session import scratch_path

#: Segments per level of the summaries.
LEVELS = (1, 4, 16)
#: Vectors of one block of anchors; a block is collected and broadcast.
BLOCK_BYTES = 16 << 20
ANCHOR_ROWS, TABLE_ROWS = 256, 4096
#: Share of the product of two lengths by which rounded summaries may be off.
SLACK = 1e-5


def levels(dim: int) -> list[int]:
    return [s for s in LEVELS if s < dim]


def summaries(vectors: np.ndarray) -> np.ndarray:
    """Per level and segment the mean, times the root of the segment's length, then the deviations."""
    parts = []
    for count in levels(vectors.shape[1]):
        cuts = np.linspace(0, vectors.shape[1], count + 1).astype(int)
        sizes = np.diff(cuts)
        total = np.add.reduceat(vectors, cuts[:-1], axis=1)
        square = np.add.reduceat(vectors * vectors, cuts[:-1], axis=1)
        parts += [total / np.sqrt(sizes), np.sqrt(np.maximum(0.0, square - total * total / sizes))]
    return np.concatenate(parts, axis=1).astype("f4") if parts else np.zeros((len(vectors), 0), "f4")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as float64 (null elements as NaN) and the length of each list (null: -1)."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat, np.where(column.is_null().to_numpy(zero_copy_only=False), -1,
                          column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _of_length(flat: np.ndarray, sizes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose lists have ``dim`` elements, and those lists as a matrix."""
    rows = np.flatnonzero(sizes == dim)
    starts = (np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0))[rows]
    return rows, flat[starts[:, None] + np.arange(dim)]


def _prepare(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _lists(batch.column(2))
            for dim in np.unique(sizes[sizes >= 0]).tolist():
                rows, found = _of_length(flat, sizes, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    found = np.floor(scale * found)
                    good = (found * found).sum(axis=1) < 2.0 ** 62  # false for NaN, too
                found, rows = found[good], rows[good]
                kept = batch.take(pa.array(rows))
                short = summaries(found)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), _list_array(found.astype("i8"), pa.int64()),
                     _list_array(short, pa.float32()), kept.column(3)],
                    names=["id", "label", "vec", "summary", "anchor"])
    return run


def _list_array(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype="i4") * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel(), kind))


def prepared(rows: DataFrame, anchors: Column, id_col: str, label_col: str, vec_col: str, scale: float) -> DataFrame:
    """Integer vectors with their summaries, written once."""
    narrow = rows.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    return stored(narrow.transform(bounded).mapInArrow(
        _prepare(scale), "id long, label long, vec array<long>, summary array<float>, anchor boolean"), "segments")


class Block:
    """Anchors of one length, ordered by label."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.number, self.ids, self.labels = number[order], ids[order], labels[order]
        self.vectors = vectors[order].astype("f8")
        self.summary = summaries(self.vectors).astype("f8")
        self.length = np.sqrt((self.vectors ** 2).sum(axis=1))


def _bounds(level: int, dim: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of means and of deviations, summed over the segments of a level."""
    at = 2 * sum(levels(dim)[:level])
    n = levels(dim)[level]
    return a[:, at:at + n] @ b[:, at:at + n].T, a[:, at + n:at + 2 * n] @ b[:, at + n:at + 2 * n].T


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact also where doubles are not."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return (a @ b.T).astype("i8") if most < 2.0 ** 53 else a.astype("i8") @ b.astype("i8").T


def surviving(block: Block, rows: np.ndarray, vectors: np.ndarray, summary: np.ndarray, allowed: np.ndarray,
              low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Allowed pairs whose score lies from ``low`` to ``high`` of its anchor: anchor, row, exact score.

    ``rows`` are positions in the block of anchors.  Rows and columns without a possible pair are left out of
    the next level.
    """
    dim = vectors.shape[1]
    cols = np.arange(len(vectors))
    alive = allowed
    for level in range(-1, len(levels(dim))):
        if level >= 0:
            mean, spread = _bounds(level, dim, block.summary[rows], summary[cols])
            spread += SLACK * block.length[rows][:, None] * np.sqrt((vectors[cols] ** 2).sum(axis=1)) + 1e-6
            alive = alive & (mean + spread >= low[:, None]) & (mean - spread <= high[:, None])
        r, c = alive.any(axis=1), alive.any(axis=0)
        rows, low, high, cols, alive = rows[r], low[r], high[r], cols[c], alive[r][:, c]
    scores = _exact(block.vectors[rows], vectors[cols])
    i, j = np.nonzero(alive & (scores >= low[:, None]) & (scores <= high[:, None]))
    return rows[i], cols[j], scores[i, j]


def _tables(batches: Iterator[pa.RecordBatch], dims: set[int]) -> Iterator[tuple]:
    """Ids, labels, vectors and summaries of up to TABLE_ROWS rows of one length."""
    for batch in batches:
        for at in range(0, batch.num_rows, TABLE_ROWS):
            part = batch.slice(at, TABLE_ROWS)
            flat, sizes = _lists(part.column(2))
            short, short_sizes = _lists(part.column(3))
            ids = part.column(0).fill_null(NO_ID).to_numpy()
            labels = part.column(1).to_numpy()
            for dim in dims & set(np.unique(sizes).tolist()):
                rows, vectors = _of_length(flat, sizes, dim)
                starts = (np.cumsum(short_sizes) - short_sizes)[rows]
                width = 2 * sum(levels(dim))
                yield dim, ids[rows], labels[rows], vectors, short[starts[:, None] + np.arange(width)]


def _few(who: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best of their query in this tile; ``who`` is in order."""
    if len(who) < 16 * k:
        return np.arange(len(who))
    order = np.lexsort((~scores, who))
    start = np.searchsorted(who[order], who, side="left")
    count = np.searchsorted(who[order], who, side="right") - start
    edge = scores[order[start + np.minimum(k, count) - 1]]
    return np.flatnonzero(scores >= edge)


def _positives(blocks, n: int, k: int):
    """Task: the k best other rows of the same label for each anchor of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = blocks.value
        best = Best(n, k)
        for dim, ids, labels, vectors, summary in _tables(batches, set(held)):
            block = held[dim]
            for at in range(0, len(block.ids), ANCHOR_ROWS):
                rows = np.arange(at, min(at + ANCHOR_ROWS, len(block.ids)))
                near = np.flatnonzero(np.isin(labels, block.labels[rows]))
                allowed = ((block.labels[rows][:, None] == labels[near])
                           & (block.ids[rows][:, None] != ids[near]))
                low = best.scores[block.number[rows], k - 1]
                r, c, s = surviving(block, rows, vectors[near], summary[near], allowed, low,
                                    np.full(len(rows), NO_ID))
                some = _few(r, s, k)
                best.add(block.number[r[some]], s[some], ids[near][c[some]])
        who, j = np.nonzero(best.scores > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(who.astype("i4")), pa.array(best.scores[who, j]),
                                          pa.array(best.ids[who, j])], names=["query", "score", "id"])
    return run


def _negatives(blocks, windows, n: int, per: int, k: int):
    """Task: the k best rows of other labels in each window of scores, ``per`` windows an anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (low, high) = blocks.value, windows.value
        best = Best(n * per, k)
        for dim, ids, labels, vectors, summary in _tables(batches, set(held)):
            block = held[dim]
            for at in range(0, len(block.ids), ANCHOR_ROWS):
                rows = np.arange(at, min(at + ANCHOR_ROWS, len(block.ids)))
                asked = block.number[rows]
                kth = best.scores[:, k - 1].reshape(n, per)[asked]
                least = np.maximum(low[asked], kth)
                is_open = least <= high[asked]
                rows, least, is_open = rows[is_open.any(axis=1)], least[is_open.any(axis=1)], is_open[is_open.any(axis=1)]
                if not len(rows):
                    continue
                top = high[block.number[rows]]
                allowed = block.labels[rows][:, None] != labels
                allowed &= block.ids[rows][:, None] != ids
                r, c, s = surviving(block, rows, vectors, summary, allowed,
                                    np.where(is_open, least, NO_ID).min(axis=1),
                                    np.where(is_open, top, LEAST).max(axis=1))
                where = np.searchsorted(rows, r)
                for j in range(per):
                    fit = np.flatnonzero(is_open[where, j] & (s >= least[where, j]) & (s <= top[where, j]))
                    fit = fit[_few(r[fit], s[fit], k)]
                    best.add(block.number[r[fit]] * per + j, s[fit], ids[c[fit]])
        who, j = np.nonzero(best.scores > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(who.astype("i4")), pa.array(best.scores[who, j]),
                                          pa.array(best.ids[who, j])], names=["query", "score", "id"])
    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")  # NO_ID is the largest id
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, id_col: str = "id", label_col: str = "label", vec_col: str = "vec", *,
         scale: float = 1.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of each anchor and positive.

    ``anchors`` says which rows are anchors.  Positives are the best ``positives`` other rows of the same label,
    negatives the best ``negatives`` rows of other labels whose score is from ``low`` to ``high`` per cent of the
    positive's.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    need(rows, id_col, label_col, vec_col)
    spark = rows.sparkSession
    made = prepared(rows, anchors, id_col, label_col, vec_col, scale)
    asked = stored(made.where("anchor").select("id", "label", "vec").distinct(), "anchors")
    keys = ("id", "label", "vec")
    parts = hash_blocks(asked, keys, F.size("vec") * 8 + 64, BLOCK_BYTES)
    path = scratch_path(spark, "llm-hard-negatives")
    found_as = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for p in range(parts):
        block = asked.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == p).toArrow()
        if block.num_rows:
            _mine_block(made, block.combine_chunks(), positives, negatives, low, high).write.mode("append").parquet(path)
    done = (spark.read.schema(found_as).parquet(path) if asked.count() else spark.createDataFrame([], found_as))
    kind = rows.schema[id_col].dataType
    ids = [F.when(F.col(c) < NO_ID, F.col(c)).cast(kind).alias(c) for c in ("anchor_id", "positive_id", "negative_id")]
    return done.select(ids[0], ids[1], "rank", ids[2], "positive_score", "negative_score")


def _mine_block(made: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = made.sparkSession
    n = anchors.num_rows
    flat, sizes = _lists(anchors["vec"].chunk(0))
    ids = anchors["id"].chunk(0).fill_null(NO_ID).to_numpy()
    labels = anchors["label"].chunk(0).to_numpy()
    held = {}
    for dim in np.unique(sizes).tolist():
        number, vectors = _of_length(flat, sizes, dim)
        held[dim] = Block(number, ids[number], labels[number], vectors)
    blocks = spark.sparkContext.broadcast(held)
    hit = "query int, score long, id long"
    columns = made.select("id", "label", "vec", "summary").transform(bounded)
    best = _ranked(columns.mapInArrow(_positives(blocks, n, positives), hit), positives).toArrow()  # n x positives
    score, who, j = (best[c].to_numpy() for c in ("score", "query", "rank"))
    at = who.astype("i8") * positives + j - 1
    pos_id, pos_score = np.zeros(n * positives, "i8"), np.zeros(n * positives, "i8")
    pos_id[at], pos_score[at] = best["id"].to_numpy(), score
    least, most = np.full(n * positives, NO_ID), np.full(n * positives, LEAST)
    least[at] = [-(-low * int(s) // 100) for s in score]  # in Python's integers, which do not overflow
    most[at] = [high * int(s) // 100 for s in score]
    windows = spark.sparkContext.broadcast((least.reshape(n, positives), most.reshape(n, positives)))
    facts = spark.sparkContext.broadcast((ids, pos_id, pos_score))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, ids_, scores_ = facts.value
        for batch in batches:
            q = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[q // positives]), pa.array(ids_[q]), batch.column(3), batch.column(2),
                 pa.array(scores_[q]), batch.column(1)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    hits = _ranked(columns.mapInArrow(_negatives(blocks, windows, n, positives, negatives), hit), negatives)
    return hits.select("query", "score", "id", "rank").mapInArrow(
        named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


@query("op11_hard_negatives", r"""
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(generate_series(1, len(a.vec)), lambda i: a.vec[i] * b.vec[i])) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
    SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0, "vec_id", "label",
                "embedding", scale=256.0)
