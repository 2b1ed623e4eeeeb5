"""Exact and approximate top-k vector search (inventory D1, D2, D10, D16, F13, G1).

Two physical strategies give the same rows:

``scan``
    The query block is small (row and byte bounds are checked first) and is
    broadcast.  The catalogue is read once, in place, without a shuffle; each
    task keeps a running top-k per query, so ``queries x tasks x k`` rows move.

``cells``
    Both sides are large.  Catalogue rows are assigned to the nearest of a
    bounded number of pivots.  Queries near each other form blocks, as large as
    ``k`` hits a query allow.  A block first reads the cells that hold its queries'
    ``k`` closest pivots' rows, which gives a lower bound on the k-th scores;
    then only cells that can still beat a bound by the triangle inequality on
    angles.  One task answers one block: the rows of the cells stream through it,
    ``block_rows`` at most at a time, are scored as matrix products, and of a query
    only its k best are kept and leave the task, once.  Exact copies of a vector
    are searched once.

Scores are rounded to 12 digits and ties go to the smaller id, so that the
strategies and an SQL oracle agree.  Vectors of length zero have no direction and
are never returned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from soundalike.functions.vectors import exact_in_float, valid_vector
from soundalike.session import cut

DIGITS = 12
MAX_SCAN_QUERIES = 4096
MAX_SCAN_BYTES = 32 << 20
MAX_PIVOTS = 16384
ANGLE_ROWS = 1024
BLOCK_ROWS = 16384
PIECE = 1 << 19  # scores that a task holds at a time
BLOCK_VALUES = 8 << 20  # of a block of queries: hits that are kept, elements of vectors
LEAST_QUERIES = 256
BROADCAST_PAIRS = 1 << 20
ANGLE_SLACK = 1e-6


# ---------------------------------------------------------------- task helpers

def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    if arr.null_count or len(np.unique(np.diff(arr.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different lengths in one search")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1)


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and the mask of rows that have a direction."""
    if m.size == 0:
        return m, np.zeros(len(m), dtype=bool)
    norms = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(norms) & (norms > 0)
    return m[ok] / norms[ok, None], ok


def _values(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(
        column, pa.Array) else column.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(
        column, pa.ChunkedArray) else np.asarray(column)


def _best(scores: np.ndarray, ranks: np.ndarray, k: int) -> np.ndarray:
    """Per row the positions of the ``k`` best scores, ties by ``ranks``."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    picked = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(scores, picked, 1).min(axis=1)
    tied = np.nonzero((scores >= edge[:, None]).sum(axis=1) > k)[0]
    for i in tied:
        cand = np.nonzero(scores[i] >= edge[i])[0]
        r = ranks[cand] if ranks.ndim == 1 else ranks[i, cand]
        picked[i] = cand[np.lexsort((r, -scores[i, cand]))[:k]]
    return picked


def _rank_of(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1].reshape(ids.shape)


class _Running:
    """Running top-k of one task for a fixed block of unit query vectors."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.scores = self.ids = self.extra = None

    def add(self, ids: np.ndarray, extra: np.ndarray, v: np.ndarray) -> None:
        step = max(1, (8 << 20) // max(1, len(v)))
        ranks = _rank_of(ids)
        parts = []
        for lo in range(0, len(self.q), step):
            s = np.round(self.q[lo:lo + step] @ v.T, DIGITS)
            pos = _best(s, ranks, self.k)
            parts.append((np.take_along_axis(s, pos, 1), ids[pos], extra[pos]))
        new = [np.concatenate(x) for x in zip(*parts)]
        if self.scores is not None:
            new = [np.concatenate([old, x], axis=1)
                   for old, x in zip((self.scores, self.ids, self.extra), new)]
            pos = _best(new[0], _rank_of(new[1]), self.k)
            new = [np.take_along_axis(x, pos, 1) for x in new]
        self.scores, self.ids, self.extra = new


def _hits_schema(query_type: T.DataType, id_type: T.DataType, extra_type: T.DataType
                 ) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", query_type), T.StructField("id", id_type),
        T.StructField("similarity", T.DoubleType()), T.StructField("extra", extra_type)])


def _emit(schema: pa.Schema, qids, ids, scores, extra, signal=None) -> pa.RecordBatch:
    columns = (qids, ids, scores, extra) if signal is None else (qids, ids, scores, extra, signal)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type, from_pandas=True) for c, f in zip(columns, schema)], schema=schema)


# -------------------------------------------------------------------- strategies

def _scan(q_ids: np.ndarray, q: np.ndarray, cat: DataFrame, k: int, out: T.StructType
          ) -> DataFrame:
    shared = cat.sparkSession.sparkContext.broadcast((q_ids, q))
    arrow = to_arrow_schema(out)

    def run(batches):
        ids_of_queries, block = shared.value
        state, held, n_held = _Running(block, k), [], 0

        def flush():
            table = pa.Table.from_batches(held)
            v, ok = _units(_matrix(table.column("vec")))
            if len(v):
                state.add(_values(table.column("id"))[ok], _values(table.column("extra"))[ok], v)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n_held += batch.num_rows
            if n_held >= BLOCK_ROWS:
                flush()
                held, n_held = [], 0
        if held:
            flush()
        if state.scores is not None:
            width = state.scores.shape[1]
            step = max(1, 65536 // width)
            for lo in range(0, len(block), step):
                hi = min(lo + step, len(block))
                yield _emit(arrow, np.repeat(ids_of_queries[lo:hi], width),
                            state.ids[lo:hi].ravel(), state.scores[lo:hi].ravel(),
                            state.extra[lo:hi].ravel())

    return cat.mapInArrow(run, out)


def _pivots(cat: DataFrame, n: int) -> np.ndarray:
    """A bounded, repeatable pick of catalogue vectors (at most ``MAX_PIVOTS``)."""
    table = (cat.select("vec", "id").orderBy(F.md5(F.col("id").cast("string")), "id")
             .limit(min(n, MAX_PIVOTS)).select("vec").toArrow())
    return _units(_matrix(table.column("vec")))[0]


def _angles(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(q @ p.T, -1.0, 1.0))


def _home_cells(angles: np.ndarray, counts: np.ndarray, need: int) -> np.ndarray:
    """Mask of the nearest cells, enough to hold ``need`` rows."""
    order = np.argsort(angles, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    take = np.zeros(angles.shape, dtype=bool)
    np.put_along_axis(take, order, before < need, axis=1)
    return take


def _without_surplus_copies(cat: DataFrame, k: int) -> DataFrame:
    """Drop rows that cannot be among the k best: all but the k smallest ids of equal vectors.

    Hashes that occur more than ``k`` times are found on narrow, pre-aggregated
    rows; only the rows of such groups are ranked, and they are cut map-side first.
    """
    cat = cat.withColumn("_h", F.xxhash64("vec"))
    crowded = cut(cat.groupBy("_h").agg(F.count("*").alias("n")).where(F.col("n") > k).select("_h"))
    if crowded.isEmpty():
        return cat.drop("_h")
    copies = Window.partitionBy("_h", "vec").orderBy("id")
    first = (cat.join(crowded, "_h", "left_semi").withColumn("_n", F.row_number().over(copies))
             .where(F.col("_n") <= k).drop("_n"))
    return cat.join(crowded, "_h", "left_anti").unionByName(first).drop("_h")


def _block_size(total: int, k: int, dim: int, tasks: int) -> int:
    """Queries of a block: two blocks a task, unless they are too small or what is kept of them (24 bytes a value) too large."""
    return min(max(1, BLOCK_VALUES // max(k, dim)), max(LEAST_QUERIES, -(-total // (2 * tasks))))


class _Best:
    """The k best rows of each query of a block, from catalogue rows that come in pieces.

    Products in single precision leave out rows that cannot reach a query's floor whatever their rounding; the
    others are scored in double precision.  Floors rise whenever what is kept is cut to k a query.
    """

    def __init__(self, q: np.ndarray, floor: np.ndarray, k: int, hold: int = 0):
        self.q, self.k, self.hold = q, k, max(hold, PIECE)  # rows held before they are cut
        self.single = q.dtype == np.float32  # then the products are the scores
        self.q4 = q if self.single else q.astype("f4")
        self.length = np.sqrt((q * q).sum(axis=1).max(initial=0.0))
        self.floor = np.where(np.isnan(floor), -np.inf, floor)
        self.score = np.empty((len(q), 0), q.dtype)  # as wide as the longest list so far; with -inf, nothing is kept there
        self.ids = self.extra = None
        self.more = []  # further values of what is kept
        self.fresh, self.n_fresh = [], 0

    def add(self, ids: np.ndarray, extra: np.ndarray, v: np.ndarray, asked: np.ndarray, value=None) -> None:
        """``value``: with products that are the scores, what else is kept of the pairs of ``rows[row]`` and ``v[col]``."""
        v4, slack = v.astype("f4", copy=False), 0.0
        if not self.single:  # above what rounding makes of a product of two such vectors
            slack = (v.shape[1] + 16) * 1.2e-7 * self.length * np.sqrt((v * v).sum(axis=1).max(initial=0.0))
        step = max(1, PIECE // max(1, len(v)))
        part = max(1, PIECE // max(1, v.shape[1]))
        for lo in range(0, len(asked), step):
            rows = asked[lo:lo + step]
            rough = self.q4[rows] @ v4.T
            new = np.isneginf(self.floor[rows])
            if len(v) >= self.k and new.any():  # the k-th best of a piece is a floor
                kth = np.partition(rough[new], len(v) - self.k, axis=1)[:, len(v) - self.k]
                self.floor[rows[new]] = kth - 2 * slack
            at = np.flatnonzero(rough >= (self.floor[rows] - 2 * slack).astype("f4")[:, None])
            row, col = np.divmod(at, max(1, len(v)))
            if self.single:
                self.fresh.append((rows[row].astype("i4"), np.round(rough.ravel()[at], DIGITS), ids[col], extra[col],
                                   *([value(rows, row, col)] if value else [])))
                self.n_fresh += len(row)
                row = row[:0]
            del rough, at
            for a in range(0, len(row), part):
                r, c = rows[row[a:a + part]], col[a:a + part]
                score = np.round(np.einsum("ij,ij->i", self.q[r], v[c]), DIGITS)
                good = score >= self.floor[r] - 1e-11
                r, c = r[good], c[good]
                self.fresh.append((r.astype("i4"), score[good], ids[c], extra[c]))
                self.n_fresh += len(r)
            if self.n_fresh > self.hold:
                self.cut()

    def cut(self) -> None:
        if not self.n_fresh:
            self.fresh = []
            return
        row, *new = (np.concatenate(x) for x in zip(*self.fresh))
        self.fresh, self.n_fresh = [], 0
        order = np.argsort(row, kind="stable")
        counts = np.bincount(row, minlength=len(self.q))
        ends, had = np.cumsum(counts), self.score.shape[1]
        if self.ids is None:
            self.ids, self.extra, *self.more = (np.empty(self.score.shape, x.dtype) for x in new[1:])
        wide = min(self.k, had + int(counts.max()))
        kept = []
        for old, x, nothing in zip((self.score, self.ids, self.extra, *self.more), new, (-np.inf, *[0] * (len(new) - 1))):
            kind = old.dtype if old.dtype == x.dtype else np.result_type(old, x)  # another piece may hold nulls
            if wide > had or kind != old.dtype:
                more = np.full((len(self.q), wide), nothing, kind)
                more[:, :had] = old
                old = more
            kept.append(old)
        self.score, self.ids, self.extra, *self.more = kept
        queries = np.flatnonzero(counts)
        queries = queries[np.argsort(-counts[queries], kind="stable")]  # queries of like counts share a table
        lo = 0
        while lo < len(queries):
            width = int(counts[queries[lo]])
            some = queries[lo:lo + max(1, PIECE // (wide + width))]
            lo += len(some)
            there = np.arange(width)[None, :] < counts[some][:, None]
            at = order[np.where(there, (ends - counts)[some][:, None] + np.arange(width), 0)]
            score, ids, *rest = (np.concatenate([old[some], x[at]], axis=1) for old, x in zip(kept, new))
            score[:, wide:][~there] = -np.inf
            pos = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            edge = np.take_along_axis(score, pos, 1).min(axis=1)
            tied = np.flatnonzero(((score >= edge[:, None]).sum(axis=1) > wide) & np.isfinite(edge))
            for i in tied:
                cand = np.flatnonzero(score[i] >= edge[i])
                pos[i] = cand[np.lexsort((_in_order(ids[i, cand]), -score[i, cand]))[:wide]]
            for old, x in zip(kept, (score, ids, *rest)):
                old[some] = np.take_along_axis(x, pos, 1)
            if wide == self.k:
                self.floor[some] = np.maximum(self.floor[some], edge)

    @property
    def few(self) -> np.ndarray:
        """Which queries have fewer than k hits."""
        return np.isfinite(self.score).sum(axis=1) < self.k

    @property
    def kept(self) -> tuple[np.ndarray, ...] | None:
        """Places of the queries, and scores, ids and extra values of what they keep, best first; None if there is nothing."""
        if self.ids is None:
            return None
        ends, *rest = self.ranked(0, len(self.q))
        return np.repeat(np.arange(len(self.q), dtype="i4"), np.diff(ends)), *rest

    def ranked(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Ends of the lists of queries ``lo`` to ``hi``, and their scores, ids and extra values, best first."""
        row, col = np.nonzero(np.isfinite(self.score[lo:hi]))
        score, ids, extra = (x[lo:hi][row, col] for x in (self.score, self.ids, self.extra))
        order = np.lexsort((_in_order(ids), -score, row))
        return np.searchsorted(row, np.arange(hi - lo + 1)), score[order], ids[order], extra[order]


def _in_order(ids: np.ndarray) -> np.ndarray:
    return ids if ids.dtype.kind in "iuf" else _rank_of(ids)


def _cells(queries: DataFrame, cat: DataFrame, k: int, out: T.StructType, *,
           n_pivots: int, block_rows: int, dim: int, in_order: bool = False, alone: bool = False) -> DataFrame:
    """The k best hits with their rank.  A task leaves them in order: if query ids do not repeat and no id is null
    (``in_order``) that order is the rank, and nothing is shuffled for it.  ``alone``: nor do the queries' vectors repeat.
    """
    spark = cat.sparkSession
    nothing = best_per_query(spark.createDataFrame([], out), k)
    q_type, id_type, x_type = (out[c].dataType for c in ("query_id", "id", "extra"))
    vec_type = cat.schema["vec"].dataType  # float vectors travel as float
    queries = queries.withColumn("_h", F.xxhash64("vec"))

    cat = _without_surplus_copies(cat, k)
    pivots = _pivots(cat, n_pivots)
    if not len(pivots):
        return nothing
    pivot_ref = spark.sparkContext.broadcast(pivots)

    def nearest_pivot(v):
        return np.concatenate([(v[a:a + ANGLE_ROWS] @ pivot_ref.value.T).argmax(axis=1)
                               for a in range(0, len(v), ANGLE_ROWS)]).astype("i4")

    assigned = T.StructType([
        T.StructField("id", id_type), T.StructField("extra", x_type),
        T.StructField("vec", vec_type), T.StructField("cell", T.IntegerType()),
        T.StructField("angle", T.DoubleType())])
    assigned_arrow = to_arrow_schema(assigned)

    def assign(batches):
        for batch in batches:
            v, ok = _units(_matrix(batch.column("vec")))
            if not len(v):
                continue
            cell = nearest_pivot(v)
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", v, pivot_ref.value[cell]), -1.0, 1.0))
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([
                kept.column("id"), kept.column("extra"), kept.column("vec"),
                pa.array(cell), pa.array(angle)], schema=assigned_arrow)

    members = cut(cat.mapInArrow(assign, assigned))
    stats = members.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # <= MAX_PIVOTS rows
    counts, radius = np.zeros(len(pivots)), np.full(len(pivots), -np.inf)
    for row in stats:
        counts[row.cell], radius[row.cell] = row.n, row.radius
    cell_ref = spark.sparkContext.broadcast((counts, radius))

    # Copies of a query vector are searched once.
    reps = queries.groupBy("_h", "vec").agg(F.min("query_id").alias("rep"))
    q_vec_type = queries.schema["vec"].dataType
    probe = T.StructType([T.StructField("rep", q_type), T.StructField("vec", q_vec_type),
                          T.StructField("home", T.IntegerType())])
    probe_arrow = to_arrow_schema(probe)

    def at_home(batches):
        for batch in batches:
            v, ok = _units(_matrix(batch.column("vec")))
            if len(v):
                kept = batch.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("rep"), kept.column("vec"), pa.array(nearest_pivot(v))], schema=probe_arrow)

    probes = cut(reps.select("rep", "vec").mapInArrow(at_home, probe))
    asked, total = [], 0
    for row in probes.groupBy("home").agg(F.count("*").alias("n")).orderBy("home").collect():
        asked.append((row.home, total, row.n))  # <= MAX_PIVOTS rows
        total += row.n
    if not total:
        return nothing
    # Blocks of queries of the same or following cells: what a task keeps (k hits a query) is bounded.
    size = _block_size(total, k, dim, spark.sparkContext.defaultParallelism)
    n_blocks = -(-total // size)
    at = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) / float(1 << 30) * F.col("n") + F.col("before")
    block = F.least(F.floor(at / size), F.lit(n_blocks - 1)).cast("int")
    left = probes.join(F.broadcast(spark.createDataFrame(asked, "home int, before long, n long")), "home").select(
        block.alias("block"), "rep", "vec", F.lit(None).cast("double").alias("floor"))
    left_arrow = to_arrow_schema(left.schema)

    def reached(v, floor, cells=slice(None)):
        reach = np.arccos(np.clip(floor, -1.0, 1.0)) + ANGLE_SLACK
        reach[~np.isfinite(floor)] = np.inf
        return _angles(v, pivot_ref.value[cells]) - cell_ref.value[1][cells][None, :] <= reach[:, None]

    def visits(second: bool):
        """(block, cell): the cells that some query of a block has to read."""
        def run(batches):
            counts_ = cell_ref.value[0]
            for batch in (b.slice(a, ANGLE_ROWS) for b in batches for a in range(0, b.num_rows, ANGLE_ROWS)):
                v = _units(_matrix(batch.column("vec")))[0]
                blocks = _values(batch.column("block"))
                chosen = (reached(v, _values(batch.column("floor"))) if second
                          else _home_cells(_angles(v, pivot_ref.value), counts_, k)) & (counts_[None, :] > 0)
                for b in np.unique(blocks):
                    cells = np.flatnonzero(chosen[blocks == b].any(axis=0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(b, len(cells)).astype("i4")), pa.array(cells.astype("i4"))],
                        names=["block", "cell"])
        return run

    hit = T.StructType([T.StructField("id", id_type), T.StructField("similarity", T.DoubleType()),
                        T.StructField("extra", x_type)])
    hits = T.StructType([T.StructField("rep", q_type), T.StructField("hits", T.ArrayType(hit))])
    hits_arrow, hit_arrow = to_arrow_schema(hits), to_arrow_schema(hit)

    def search_block(second: bool):
        """One task, one block: its queries come first, then the rows of the cells that it reads."""
        def run(batches):
            asked, best = [], None

            def begin():
                table = pa.Table.from_batches(asked)
                v = _units(_matrix(table.column("vec")))[0]
                return table, _Best(v, _values(table.column("floor")), k)

            for batch in batches:
                cells = _values(batch.column("cell"))
                n_asked = int(np.searchsorted(cells, 0))
                if n_asked:
                    asked.append(batch.slice(0, n_asked))
                if n_asked == batch.num_rows:
                    continue
                if best is None:
                    table, best = begin()
                batch, cells = batch.slice(n_asked), cells[n_asked:]
                v, ids, extra = (_units(_matrix(batch.column("vec")))[0], _values(batch.column("id")),
                                 _values(batch.column("extra")))
                found, first = np.unique(cells, return_index=True)
                for cell, a, b in zip(found, first, [*first[1:], len(cells)]):
                    rows = (np.flatnonzero(reached(best.q, best.floor, [cell])[:, 0]) if second
                            else np.arange(len(best.q)))
                    for lo in range(a, b, block_rows):
                        part = slice(lo, min(b, lo + block_rows))
                        best.add(ids[part], extra[part], v[part], rows)
            if best is None:
                if not asked:
                    return
                table, best = begin()
            best.cut()
            if not second:  # the queries again, with the floors that their home cells give
                table = table.select(left_arrow.names).set_column(
                    left_arrow.get_field_index("floor"), "floor", pa.array(best.floor, mask=best.few))
                yield from table.cast(left_arrow).combine_chunks().to_batches(max_chunksize=10000)
            elif best.ids is not None:
                reps_ = table.column("rep").combine_chunks()
                step = max(1, 65536 // k)
                for lo in range(0, len(best.q), step):
                    hi = min(lo + step, len(best.q))
                    ends, score, ids, extra = best.ranked(lo, hi)
                    flat = [pa.array(c, type=f.type, from_pandas=True) for c, f in zip((ids, score, extra), hit_arrow)]
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")),
                                                     pa.StructArray.from_arrays(flat, fields=list(hit_arrow)))
                    yield pa.RecordBatch.from_arrays([reps_.slice(lo, hi - lo), lists.cast(hits_arrow.field("hits").type)],
                                                     schema=hits_arrow)
        return run

    same = vec_type if vec_type == q_vec_type else T.ArrayType(T.DoubleType())

    def visit(left: DataFrame, second: bool) -> DataFrame:
        pairs = cut(left.mapInArrow(visits(second), "block int, cell int").distinct())
        if pairs.count() <= BROADCAST_PAIRS:
            pairs = F.broadcast(pairs)
        none = F.lit(None)
        rows = left.select("block", F.lit(-1).alias("cell"), "rep", "floor", none.cast(id_type).alias("id"),
                           none.cast(x_type).alias("extra"), F.col("vec").cast(same).alias("vec"))
        rows = rows.unionByName(members.join(pairs, "cell").select(
            "block", "cell", none.cast(q_type).alias("rep"), none.cast("double").alias("floor"), "id", "extra",
            F.col("vec").cast(same).alias("vec")))
        rows = rows.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("cell")
        return rows.mapInArrow(search_block(second), hits if second else left.schema)

    floored = cut(visit(left, False)) if len(pivots) > 1 else left
    by_rep = visit(floored, True)
    if alone:
        found = by_rep.withColumnRenamed("rep", "query_id")
    else:
        owners = queries.join(queries.groupBy("_h", "vec").agg(F.min("query_id").alias("rep")), ["_h", "vec"]).select(
            "query_id", "rep")
        found = owners.join(by_rep, "rep")
    hits = found.select("query_id", F.posexplode("hits").alias("n", "h")).select(
        "query_id", "h.id", "h.similarity", "h.extra", (F.col("n") + 1).alias("rank"))
    return hits if in_order else best_per_query(hits.drop("rank"), k)


# ------------------------------------------------------------------- public API

def best_per_query(hits: DataFrame, k: int | str) -> DataFrame:
    """G1: the k best rows of each query with their rank, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    bound = F.lit(k) if isinstance(k, int) else F.col(k)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= bound)


def nearest(queries: DataFrame, songs: DataFrame, k: int, *, vec: str = "learned",
            query_vec: str = "vector", extra: str = "bpm", strategy: str = "auto",
            n_pivots: int | None = None, block_rows: int = BLOCK_ROWS,
            max_scan_queries: int = MAX_SCAN_QUERIES, dim: int | None = None) -> DataFrame:
    """The ``k`` songs of highest cosine similarity for each row of ``queries``.

    Vectors have ``dim`` elements, by default as many as the longest query; rows of another
    length, or with a missing or NaN element, are not searched (:func:`rejected` counts them).

    ``queries``: ``query_id``, a vector.  Result: ``query_id, id, similarity,
    extra, rank``; ``extra`` is one catalogue column carried along for filters
    that apply after the pool is fixed.  Choosing the strategy runs one bounded
    action on ``queries``.
    """
    q = queries.where(F.col(query_vec).isNotNull()).select(
        "query_id", F.col(query_vec).alias("vec"))
    cat = songs.where(F.col(vec).isNotNull()).select(
        "id", F.col(extra).alias("extra"), F.col(vec).alias("vec"))
    out = _hits_schema(q.schema["query_id"].dataType, cat.schema["id"].dataType,
                       cat.schema["extra"].dataType)
    if strategy in ("auto", "scan"):
        head = q.limit(max_scan_queries + 1).toArrow()
        fits = head.num_rows <= max_scan_queries and head.nbytes <= MAX_SCAN_BYTES
        if strategy == "scan" and not fits:
            raise ValueError("too many queries for the scan strategy; use 'cells'")
        if fits:
            head, dim = _of_length(head.combine_chunks(), dim)
            m, ok = _units(_matrix(head.column("vec")))
            if not len(m):
                return best_per_query(songs.sparkSession.createDataFrame([], out), k)
            hits = _scan(_values(head.column("query_id"))[ok], m, cat.where(valid_vector("vec", dim)), k, out)
            return best_per_query(hits, k)
    if dim is None:
        dim = q.agg(F.max(F.size("vec"))).first()[0] or 0
    # The catalogue is read once; all steps of the search start from its narrow copy.
    q, cat = q.where(valid_vector("vec", dim)), cut(cat.where(valid_vector("vec", dim)))
    n, short, no_id = cat.agg(F.count("*"), F.min(exact_in_float("vec")), F.max(F.col("id").isNull())).first()
    if short and q.agg(F.min(exact_in_float("vec"))).first()[0]:
        # Vectors that are whole in four bytes an element travel so, and are scored as doubles all the same.
        q, cat = (df.withColumn("vec", F.col("vec").cast("array<float>")) for df in (q, cat))
    if n_pivots is None:
        n_pivots = int(min(MAX_PIVOTS, max(1, n // BLOCK_ROWS)))
    # A repeated or null id, or two vectors of one hash, only cost the longer way.
    rows, ids, vecs = q.agg(F.count("*"), F.count_distinct("query_id"), F.count_distinct(F.xxhash64("vec"))).first()
    in_order = not no_id and rows == ids
    return _cells(q, cat, k, out, n_pivots=n_pivots, block_rows=block_rows, dim=dim, in_order=in_order,
                  alone=in_order and vecs == rows)


def _scan_signals(blocks: dict[str, tuple[np.ndarray, np.ndarray]], cat: DataFrame, k: int,
                  out: T.StructType) -> DataFrame:
    """As :func:`_scan` for several vector columns: ``blocks`` has the queries of each, rows are read once."""
    shared = cat.sparkSession.sparkContext.broadcast(blocks)
    arrow = to_arrow_schema(out)

    def run(batches):
        states = {name: _Running(q, k) for name, (_, q) in shared.value.items()}
        held, n_held = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            for name, state in states.items():
                have = table.filter(table.column(name).is_valid())
                v, ok = _units(_matrix(have.column(name)))
                if len(v):
                    state.add(_values(have.column("id"))[ok], _values(have.column("extra"))[ok], v)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n_held += batch.num_rows
            if n_held >= BLOCK_ROWS:
                flush()
                held, n_held = [], 0
        if held:
            flush()
        for name, state in states.items():
            if state.scores is None:
                continue
            ids, width = shared.value[name][0], state.scores.shape[1]
            step = max(1, 65536 // width)
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                columns = (np.repeat(ids[lo:hi], width), state.ids[lo:hi].ravel(), state.scores[lo:hi].ravel(),
                           state.extra[lo:hi].ravel(), np.repeat(name, (hi - lo) * width))
                yield _emit(arrow, *columns[:4], signal=columns[4])

    return cat.mapInArrow(run, out)


def nearest_by_signal(rows: DataFrame, k: int, signals: list[str], extra: str = "bpm") -> DataFrame:
    """The ``k`` rows nearest to every row by each of several vector columns: as :func:`nearest`, with ``signal``.

    If the queries fit the scan for all signals together, the table is read once for all of them.  Larger
    tables are copied once in narrow form, which then serves a search per signal.
    """
    cat = rows.select("id", F.col(extra).alias("extra"), *signals)
    hits = _hits_schema(cat.schema["id"].dataType, cat.schema["id"].dataType, cat.schema["extra"].dataType)
    out = T.StructType([*hits, T.StructField("signal", T.StringType())])
    head = cat.drop("extra").limit(MAX_SCAN_QUERIES + 1).toArrow()
    if head.num_rows <= MAX_SCAN_QUERIES and head.nbytes <= MAX_SCAN_BYTES:
        blocks, whole = {}, []
        for name in signals:
            some, dim = _of_length(head.select(["id", name]).filter(head.column(name).is_valid()).combine_chunks(), None, name)
            m, ok = _units(_matrix(some.column(name)))
            if len(m):
                blocks[name] = (_values(some.column("id"))[ok], m)
            whole.append(F.when(valid_vector(name, dim), F.col(name)).alias(name))
        found = _scan_signals(blocks, cat.select("id", "extra", *whole), k, out)
    else:
        cat = cut(cat)
        parts = [nearest(cat.select(F.col("id").alias("query_id"), F.col(name).alias("vector")), cat, k, vec=name,
                         extra="extra").drop("rank").withColumn("signal", F.lit(name)) for name in signals]
        found = functools.reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("signal", "query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _of_length(head: pa.Table, dim: int | None, name: str = "vec") -> tuple[pa.Table, int]:
    """Rows of a bounded query block whose vectors are whole and have ``dim`` (the most) elements."""
    if not head.num_rows:
        return head, dim or 0
    vec = head.column(name).combine_chunks()
    sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
    dim = int(sizes.max()) if dim is None else dim
    flat = vec.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(np.isnan(flat))))
    ends = np.cumsum(sizes).astype(int)
    keep = (sizes == dim) & (bad[ends] == bad[ends - sizes.astype(int)])
    return head.filter(pa.array(keep)), dim


def top_k(queries: DataFrame, songs: DataFrame, k: int = 20, *, vec: str = "learned",
          query_vec: str = "vector", min_bpm: float = 0, max_bpm: float = 999,
          exclude: str | None = None, match_count: str | None = None,
          filter_mode: str = "post", pool_factor: int = 5, cap: int | None = None,
          method: str = "exact", target: float = 0.9, **search) -> DataFrame:
    """Top-k search with tempo filter.  Result: ``query_id, id, similarity, rank``.

    ``filter_mode="post"`` fixes a pool of ``pool_factor * k`` first and filters it,
    ``"pre"`` filters the catalogue (also dropping failed rows) first; ``cap`` bounds
    ``k``.  ``exclude`` names a column of ``queries`` with an id that
    must not be returned; ``"query_id"`` excludes the query itself.
    ``match_count`` names a column with a smaller k per query.  ``method="approx"`` finds the share
    ``target`` of the exact pool or more, at whatever effort that takes (:mod:`.approximate`).
    """
    if method == "approx":
        from soundalike.operators import approximate
        find = functools.partial(approximate.nearest, target=target)
    else:
        find = nearest
    in_range = F.col("bpm").between(min_bpm, max_bpm)
    if cap is not None:
        k = min(k, cap)
    if filter_mode == "pre":
        songs = songs.where(in_range & (F.col("metadata_status") != "failed"))
        pool = find(queries, songs, k + (1 if exclude else 0), vec=vec, query_vec=query_vec, **search)
    else:
        pool = find(queries, songs, k * pool_factor, vec=vec, query_vec=query_vec, **search)
        pool = pool.where(F.col("extra").between(min_bpm, max_bpm))
    wanted = [c for c in {exclude, match_count} - {None, "query_id"}]
    if wanted:
        pool = pool.join(queries.select("query_id", *wanted), "query_id")
    if match_count and filter_mode == "post":
        pool = pool.where(F.col("rank") <= F.col(match_count) * pool_factor)
    if exclude:
        pool = pool.where(~F.col("id").eqNullSafe(F.col(exclude)))
    ranked = best_per_query(pool.drop("rank"), match_count or k)
    return ranked.select("query_id", "id", "similarity", "rank")


def rejected(songs: DataFrame, dim: int, vec: str = "learned") -> DataFrame:
    """Rows that a search over vectors of ``dim`` elements leaves out, by reason."""
    reason = (F.when(F.col(vec).isNull(), "missing").when(F.size(vec) != dim, "length")
              .when(~valid_vector(vec, dim), "element"))
    return songs.select(reason.alias("reason")).where("reason is not null").groupBy("reason").count()


def nearest_for_new(new_songs: DataFrame, songs: DataFrame, k: int = 20, **search) -> DataFrame:
    """The k nearest songs of newly arrived songs, themselves excluded."""
    queries = new_songs.select(F.col("id").alias("query_id"), F.col("learned").alias("vector"))
    return top_k(queries, songs, k, exclude="query_id", **search)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate result has, per query and overall."""
    hit = approx.select("query_id", "id", F.lit(1).alias("hit"))
    return (exact.join(hit, ["query_id", "id"], "left")
            .agg(F.count("*").alias("exact_hits"),
                 F.count("hit").alias("found"),
                 (F.count("hit") / F.count("*")).alias("recall")))
