"""Approximate top-k vector search with a recall target (inventory D16).

Unit vectors are assigned to the nearest of ``cells`` centroids, and what is left of them (the residual) is
coded by a product quantiser: its parts are replaced by the nearest of 256 words each, so a vector of any length
is one cell and ``PARTS`` bytes.  A query reads the cells nearest to it, adds up table look-ups for each code, and
keeps a short list, whose exact scores decide.

How many cells are read and how long the short list is follow from a target, not from the size of the catalogue.
For ``CHECKED`` of the queries the exact hits are found by brute force.  The cells of those hits give the number of
cells to read, and the number of codes that score better than a hit's code gives the length of the list: both are
read off the measured ranks of the hits, at the smallest values that reach the target among them with a margin.
Centroids and words are fitted on a bounded sample; every vector is coded.

Queries near each other form blocks, as large as their short lists allow.  One task answers one block: its queries come
first, then the vectors of the cells that they read, with their codes.  What gets into a short list is scored exactly
as it comes, so vectors move once a block, whatever the length of the lists.  No query is read by the driver.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from soundalike.functions.vectors import exact_in_float, norm, valid_vector
from soundalike.operators import search
from soundalike.session import cut

SAMPLE = 16384
MAX_CELLS = 1024
PARTS = 16
WORDS = 256
CHECKED = 128
QUERY_BLOCK = 16384
DENSE = 128  # from one pair in so many on, a product of all pairs is cheaper than one by one


@dataclass
class Codebook:
    centroids: np.ndarray
    words: list[np.ndarray]  # per part: words of it
    cuts: np.ndarray

    def code(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.concatenate([(part @ self.centroids.T).argmax(axis=1) for part in _pieces(units)])
        rest = units - self.centroids[cell]
        codes = np.empty((len(units), len(self.words)), "u1")
        for m, w in enumerate(self.words):
            part = rest[:, self.cuts[m]:self.cuts[m + 1]]
            codes[:, m] = np.concatenate([((w * w).sum(axis=1) - 2 * p @ w.T).argmin(axis=1) for p in _pieces(part)])
        return cell.astype("i4"), codes

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes stand for: a query's product with it is the sum of its look-ups."""
        return (self.centroids[cell] + np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)).astype("f4")

    def tables(self, units: np.ndarray) -> np.ndarray:
        """Per query, part and word the product of the query's part with the word."""
        return np.stack([_padded(units[:, self.cuts[m]:self.cuts[m + 1]] @ w.T) for m, w in enumerate(self.words)], axis=1)


def _padded(m: np.ndarray) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, WORDS - m.shape[1])))


def _pieces(m: np.ndarray) -> list[np.ndarray]:
    return np.array_split(m, max(1, -(-len(m) // 2048)))


def _means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means from evenly spaced points; a mean without points keeps its place."""
    means = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([((means * means).sum(axis=1) - 2 * p @ means.T).argmin(axis=1) for p in _pieces(points)])
        total = np.zeros_like(means)
        np.add.at(total, own, points)
        n = np.bincount(own, minlength=len(means))
        means[n > 0] = total[n > 0] / n[n > 0, None]
    return means


def fit(cat: DataFrame, cells: int) -> Codebook | None:
    """Centroids and words from a bounded, repeatable sample of ``vec``."""
    table = (cat.select("vec", "id").orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE)
             .select("vec").toArrow())
    units = search._units(search._matrix(table.column("vec")))[0]
    if not len(units):
        return None
    centroids = search._units(_means(units, cells))[0]
    cuts = np.linspace(0, units.shape[1], min(PARTS, units.shape[1]) + 1).astype(int)
    rest = units - centroids[np.concatenate([(p @ centroids.T).argmax(axis=1) for p in _pieces(units)])]
    return Codebook(centroids, [_means(rest[:, a:b], WORDS) for a, b in zip(cuts[:-1], cuts[1:])], cuts)


def encode(cat: DataFrame, book) -> DataFrame:
    """The rows whose ``vec`` has a direction, with ``cell`` and ``codes``."""
    out = T.StructType([*cat.schema, T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            units, ok = search._units(search._matrix(batch.column("vec")))
            if len(units):
                cell, codes = Codebook(*book.value).code(units)
                yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(ok)).columns, pa.array(cell), pa.array(
                    [c.tobytes() for c in codes], pa.binary())], schema=arrow)
    return cat.mapInArrow(run, out)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    start = column.offset
    ends = np.frombuffer(column.buffers()[1], "<i4")[start:start + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", "u1")[ends[0]:ends[-1]].reshape(-1, parts)


def _scores(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Queries x rows: the sums of look-ups."""
    out = np.zeros((len(tables), len(codes)), "f4")
    for m in range(codes.shape[1]):
        out += tables[:, m, :][:, codes[:, m]]
    return out


def _by_cell(batch: pa.RecordBatch, wanted: np.ndarray, parts: int):
    """Per cell that a query reads: the queries, the rows of the batch, their codes."""
    cells = batch.column("cell").to_numpy()
    codes = _codes(batch.column("codes"), parts)
    order = np.argsort(cells, kind="stable")
    found, first = np.unique(cells[order], return_index=True)
    for cell, a, b in zip(found, first, [*first[1:], len(order)]):
        asked = np.flatnonzero(wanted[:, cell])
        if len(asked):
            yield cell, asked, order[a:b], codes[order[a:b]]


def _nearest_cells(units: np.ndarray, book: Codebook) -> np.ndarray:
    """Per query the place of each cell in the order in which it would read them."""
    order = np.argsort(-(units @ book.centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    return place


@dataclass
class Plan:
    """What calibration found: cells to read, length of the short list, recall on the checked queries."""

    probes: int
    short: int
    recall: float


def calibrate(units: np.ndarray, hits: list[np.ndarray], coded: DataFrame, book_ref, target: float, k: int) -> Plan:
    """The least effort that finds ``target`` of the checked queries' exact hits, with half the rest as a margin.

    Two bounded jobs: cells and codes of the hits, and how many codes score better than each hit's.
    """
    book, spark = Codebook(*book_ref.value), coded.sparkSession
    wanted = sorted({i for h in hits for i in h.tolist()})
    if not wanted:
        return Plan(1, k, 1.0)
    goal = (1 + target) / 2
    kind = coded.schema["id"].dataType
    ids = F.broadcast(spark.createDataFrame([(i,) for i in wanted], T.StructType([T.StructField("id", kind)])))
    rows = coded.join(ids, "id").toArrow()  # at most CHECKED * k, and rows that share an id
    at = dict(zip(rows["id"].to_pylist(), zip(rows["cell"].to_pylist(), rows["codes"].to_pylist())))
    place, tables = _nearest_cells(units, book), book.tables(units).astype("f4")
    pairs = [(q, *at[i]) for q, h in enumerate(hits) for i in h.tolist()]
    asked = np.array([q for q, _, _ in pairs])
    cell = np.array([c for _, c, _ in pairs])
    order = np.sort(place[asked, cell])
    probes = int(order[max(0, int(np.ceil(np.sqrt(goal) * len(order))) - 1)]) + 1
    base = units @ book.centroids.T
    own = np.array([_scores(tables[q:q + 1], np.frombuffer(c, "u1")[None, :])[0, 0] + base[q, x]
                    for q, x, c in pairs]) - 1e-5
    shared = spark.sparkContext.broadcast((tables, place < probes, base, asked, own))

    def run(batches):
        tables_, reads, base_, asked_, own_ = shared.value
        better = np.zeros(len(own_), "i8")
        of = [np.flatnonzero(asked_ == q) for q in range(len(tables_))]
        for batch in batches:
            for c, queries, _, codes in _by_cell(batch, reads, tables_.shape[1]):
                scores = _scores(tables_[queries], codes) + base_[queries, c][:, None]
                for q, s in zip(queries, scores):
                    better[of[q]] += len(s) - np.searchsorted(np.sort(s), own_[of[q]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(better))), pa.array(better)], names=["pair", "n"])

    rank = np.zeros(len(pairs), "i8")
    for r in coded.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        rank[r["pair"]] = r["n"]
    rank[place[asked, cell] >= probes] = np.iinfo("i8").max
    order = np.sort(rank)
    read = order[order < np.iinfo("i8").max]
    short = int(read[min(len(read), int(np.ceil(goal * len(order)))) - 1]) if len(read) else k
    short = max(k, short)
    return Plan(probes, short, float((rank <= short).mean()))


def _reads(units: np.ndarray, book: Codebook, probes: int) -> np.ndarray:
    """Per query which cells it reads."""
    out = np.empty((len(units), len(book.centroids)), bool)
    for a in range(0, len(units), search.ANGLE_ROWS):
        out[a:a + search.ANGLE_ROWS] = _nearest_cells(units[a:a + search.ANGLE_ROWS], book) < probes
    return out


def _pair_scores(a: np.ndarray, b: np.ndarray, rows: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact products of ``a[rows[row]]`` and ``b[col]``."""
    if len(row) * DENSE > len(rows) * len(b):
        return np.round((a[rows] @ b.T)[row, col], search.DIGITS)
    step = max(1, search.PIECE // max(1, b.shape[1]))
    return np.round(np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[rows[row[at:at + step]]], b[col[at:at + step]])
                                                   for at in range(0, len(row), step))]), search.DIGITS)


def _of_short(best: search._Best, lo: int, hi: int, k: int) -> tuple[np.ndarray, ...]:
    """Ends of the lists of queries ``lo`` to ``hi``, and exact scores, ids and extra values of their ``k`` best, best first."""
    there = np.isfinite(best.score[lo:hi])
    rank = np.zeros(there.shape)
    rank[there] = search._rank_of(best.ids[lo:hi][there])
    score = np.where(there, best.more[0][lo:hi], -np.inf)
    pos = search._best(score, rank, k)
    score, rank, ids, extra = (np.take_along_axis(x, pos, 1) for x in (score, rank, best.ids[lo:hi], best.extra[lo:hi]))
    row, col = np.nonzero(np.isfinite(score))
    order = np.lexsort((rank[row, col], -score[row, col], row))
    row, col = row[order], col[order]
    return np.searchsorted(row, np.arange(hi - lo + 1)), score[row, col], ids[row, col], extra[row, col]


def _answers(asked: DataFrame, coded: DataFrame, book_ref, plan: Plan, k: int) -> DataFrame:
    """``n, query_id, id, similarity, extra, rank``: the ``k`` best of the short list of each row of ``asked``, in one job.

    ``asked``: ``n`` (which does not repeat), ``query_id, vec, home``, its nearest cell.
    """
    spark = coded.sparkSession
    homes, total = [], 0
    for row in asked.groupBy("home").agg(F.count("*").alias("m")).orderBy("home").collect():  # <= MAX_CELLS rows
        homes.append((row.home, total, row.m))
        total += row.m
    dim = len(book_ref.value[0][0])
    # As in the exact search; a third more is kept of a hit, its exact score.
    size = min(QUERY_BLOCK, search._block_size(total, max(k, plan.short) * 4 // 3, dim, spark.sparkContext.defaultParallelism))
    n_blocks = -(-total // size)
    at = F.pmod(F.xxhash64("n"), F.lit(1 << 30)) / float(1 << 30) * F.col("m") + F.col("before")
    block = F.least(F.floor(at / size), F.lit(n_blocks - 1)).cast("int")
    left = asked.join(F.broadcast(spark.createDataFrame(homes, "home int, before long, m long")), "home").select(
        block.alias("block"), "n", "query_id", "vec")

    def visits(batches):
        book = Codebook(*book_ref.value)
        for batch in (b.slice(a, search.ANGLE_ROWS) for b in batches for a in range(0, b.num_rows, search.ANGLE_ROWS)):
            reads = _reads(search._units(search._matrix(batch.column("vec")))[0], book, plan.probes)
            blocks = batch.column("block").to_numpy()
            for b in np.unique(blocks):
                cells = np.flatnonzero(reads[blocks == b].any(axis=0)).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), b, "i4")), pa.array(cells)], names=["block", "cell"])

    kind = {f.name: f.dataType for f in [*left.schema, *coded.schema]}
    hit = T.StructType([T.StructField("id", kind["id"]), T.StructField("similarity", T.DoubleType()),
                        T.StructField("extra", kind["extra"])])
    lists = T.StructType([*left.select("n", "query_id").schema, T.StructField("hits", T.ArrayType(hit))])
    lists_arrow, hit_arrow = to_arrow_schema(lists), to_arrow_schema(hit)

    def run(batches):
        book, asked_, best = Codebook(*book_ref.value), [], None

        def begin():
            table = pa.Table.from_batches(asked_)
            units = search._units(search._matrix(table.column("vec")))[0]
            return table, units, _reads(units, book, plan.probes), search._Best(
                units.astype("f4"), np.full(len(units), np.nan), plan.short, len(units) * plan.short // 4)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            n_asked = int(np.searchsorted(cells, 0))
            if n_asked:
                asked_.append(batch.slice(0, n_asked).select(["n", "query_id", "vec"]))
            if n_asked == batch.num_rows:
                continue
            if best is None:
                table, units, reads, best = begin()
            batch, cells = batch.slice(n_asked), cells[n_asked:]
            v, ids, extra = (search._units(search._matrix(batch.column("vec")))[0], search._values(batch.column("id")),
                             search._values(batch.column("extra")))
            codes = _codes(batch.column("codes"), len(book.words))
            found, first = np.unique(cells, return_index=True)
            for cell, a, b in zip(found, first, [*first[1:], len(cells)]):
                who = np.flatnonzero(reads[:, cell])
                if len(who):
                    best.add(ids[a:b], extra[a:b], book.decoded(cells[a:b], codes[a:b]), who,
                             functools.partial(_pair_scores, units, v[a:b]))
        if best is None:
            return
        best.cut()
        if best.ids is None:
            return
        step = max(1, 65536 // k)
        for lo in range(0, len(units), step):
            hi = min(lo + step, len(units))
            ends, score, ids, extra = _of_short(best, lo, hi, k)
            flat = [pa.array(c, type=f.type, from_pandas=True) for c, f in zip((ids, score, extra), hit_arrow)]
            hits = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.StructArray.from_arrays(flat, fields=list(hit_arrow)))
            some = table.slice(lo, hi - lo).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(some.column(c).combine_chunks() for c in ("n", "query_id")),
                                              hits.cast(lists_arrow.field("hits").type)], schema=lists_arrow)

    pairs = cut(left.mapInArrow(visits, "block int, cell int").distinct())
    if pairs.count() <= search.BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    none, same = F.lit(None), T.ArrayType(T.DoubleType()) if kind["vec"] != left.schema["vec"].dataType else kind["vec"]
    rows = left.select("block", F.lit(-1).alias("cell"), "n", "query_id", *(none.cast(kind[c]).alias(c) for c in ("id", "extra")),
                       F.col("vec").cast(same).alias("vec"), none.cast("binary").alias("codes"))
    rows = rows.unionByName(coded.join(pairs, "cell").select(
        "block", "cell", none.cast("long").alias("n"), none.cast(kind["query_id"]).alias("query_id"), "id", "extra",
        F.col("vec").cast(same).alias("vec"), "codes"))
    found = rows.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("cell").mapInArrow(run, lists)
    return found.select("n", "query_id", F.posexplode("hits").alias("at", "h")).select(
        "n", "query_id", "h.id", "h.similarity", "h.extra", (F.col("at") + 1).alias("rank"))


def _exact(pairs: DataFrame, out: T.StructType) -> DataFrame:
    """Exact scores of pairs of ``asked`` and ``vec``."""
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            v, q = (search._units(search._matrix(batch.column(c)))[0] for c in ("vec", "asked"))
            if len(v):
                every = np.arange(len(v))
                yield search._emit(arrow, batch.column("query_id"), batch.column("id"), _pair_scores(q, v, every, every, every),
                                   batch.column("extra"))
    return pairs.select("query_id", "id", "extra", "vec", "asked").mapInArrow(run, out)


def nearest(queries: DataFrame, songs: DataFrame, k: int, *, target: float = 0.9, vec: str = "learned",
            query_vec: str = "vector", extra: str = "bpm", dim: int | None = None,
            plans: list[Plan] | None = None) -> DataFrame:
    """About the ``k`` nearest songs of each query: ``target`` of the exact hits or more, as measured.

    Same columns as :func:`search.nearest`, and exact scores.  Plans that were used are appended to ``plans``.
    Songs without an id are not found; all songs of an id are that one of them is short-listed.
    """
    q = queries.where(F.col(query_vec).isNotNull()).select("query_id", F.col(query_vec).alias("vec"))
    if dim is None:
        dim = q.agg(F.max(F.size("vec"))).first()[0] or 0
    q = cut(q.where(valid_vector("vec", dim)))
    cat = cut(songs.select("id", F.col(extra).alias("extra"), F.col(vec).alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & valid_vector("vec", dim)))
    out = search._hits_schema(q.schema["query_id"].dataType, cat.schema["id"].dataType, cat.schema["extra"].dataType)
    spark = songs.sparkSession
    n_queries, n_asked, short_q = q.agg(F.count("*"), F.count_distinct("query_id"), F.min(exact_in_float("vec"))).first()
    n, n_ids, short = cat.agg(F.count("*"), F.count_distinct("id"), F.min(exact_in_float("vec"))).first()
    book = fit(cat, int(min(MAX_CELLS, max(1, n ** 0.5)))) if n and n_queries else None
    if book is None:
        return search.best_per_query(spark.createDataFrame([], out), k)
    book_ref = spark.sparkContext.broadcast((book.centroids, book.words, book.cuts))  # arrays: executors know no class of ours
    narrow = T.ArrayType(T.FloatType() if short and short_q else T.DoubleType())  # where that is exact
    coded = cut(encode(cat.withColumn("vec", F.col("vec").cast(narrow)), book_ref))

    by_hash = F.md5(F.col("query_id").cast("string"))
    some = q.orderBy(by_hash, "query_id").limit(CHECKED).toArrow()
    units, ok = search._units(search._matrix(some.column("vec")))
    numbered = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)], "query_id int, vec array<double>")
    exact = search.nearest(numbered, cat, k, vec="vec", query_vec="vec", extra="extra", strategy="scan", dim=dim)
    hits: list[list] = [[] for _ in units]
    for r in exact.select("query_id", "id").collect():  # CHECKED * k rows
        hits[r.query_id].append(r.id)
    plan = calibrate(units, [np.array(h) for h in hits], coded.select("id", "cell", "codes"), book_ref, target, k)
    if plans is not None:
        plans.append(plan)

    home = T.StructType([T.StructField("n", T.LongType()), q.schema["query_id"], T.StructField("vec", narrow),
                         T.StructField("home", T.IntegerType())])
    home_arrow = to_arrow_schema(home)

    def at_home(batches):
        centroids = book_ref.value[0]
        for batch in batches:
            v, ok_ = search._units(search._matrix(batch.column("vec")))
            if len(v):
                cell = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in _pieces(v)]).astype("i4")
                yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(ok_)).columns, pa.array(cell)], schema=home_arrow)

    asked = cut(q.select(F.monotonically_increasing_id().alias("n"), "query_id", F.col("vec").cast(narrow).alias("vec"))
                .mapInArrow(at_home, home))
    if asked.isEmpty():
        return search.best_per_query(spark.createDataFrame([], out), k)
    once = n_ids == n
    found = _answers(asked, coded, book_ref, plan, k if once else plan.short)
    if not once:  # the short lists are ids: all songs of an id are scored
        found = _exact(found.select("n", "id").join(cat, "id").join(
            asked.select("n", "query_id", F.col("vec").alias("asked")), "n").where(norm("vec") > 0), out)
    if once and n_asked == n_queries:
        return found.drop("n")
    return search.best_per_query(found.select(*out.names), k)
