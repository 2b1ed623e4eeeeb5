"""Exact join of documents by the Jaccard similarity of their word shingles, as a join in a metric space.

Jaccard distance, and the size of the symmetric difference, are metrics on sets, and any set may serve as a pivot.
Regions are made around pivots twice, and all filters are triangle inequalities:

1. *Sets of one shingle* as pivots.  Shingles are ordered from rare to frequent; a document's region is that of its
   first shingle.  Against the set of all shingles before pivot ``s`` two linked documents differ by no more than
   from each other, so a document has a partner in the region of ``s`` only if at most ``(1 - t)`` of its shingles
   stand before ``s``: into so many regions, and no more, a document is replicated.
2. *Documents* as pivots, where a region is still large: members go to the nearest of up to ``PIVOTS`` pivots, and
   into a later region ``q`` also if ``d(x, q) <= d(x, own) + 2e`` and ``d(x, q) <= radius(q) + e`` with
   ``e = 1 - t``.  Every pair is together in the later one of its two regions.  Regions are split on until they
   are small, or until a split would leave half of their pairs; those are joined block against block.

Before any set travels, 64 pivot sets (all shingles of one hash class; 1,024 for long texts) give each document a
short vector of intersection sizes, whose distance the symmetric difference bounds: members without a possible
partner leave their region.  First each document is compared with one member of its regions, and members linked by
that are connected; later steps look at pairs in different components only, and groups return a forest of links,
never all pairs.

Equal sets are one node from the start, so copies are compared once, whatever their number.  Frequencies are hashed
counts over all documents; they decide the order of pivots and nothing else, so the join is exact with any.

Defined results: A-Z are lower-cased, words are runs without white space; a text of one or two words has one
shingle.  A text without words (null, empty, blank) has none and is linked with nothing.  The component is named by
its smallest id; null ids count only where a component has no other.  Repeated rows are in one component.  Very
long texts are read whole; groups are bounded in bytes.  Empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, need, query, stored, table
from soundalike.llm.components import components
from soundalike.llm.exact_dedup import maybe_repeated, repeat_filter
from soundalike.llm.kernels import mix, text_blocks, windows, word_hashes

WIDTH = 3
PERCENT = 90
#: Hashed counts of shingles and of words, collected and broadcast: 10 MB whatever the input.
COUNTERS, WORD_BITS = 1 << 18, 20
#: Pivot sets of the short vectors: so many, and for sets of LONG or more shingles so many as parts of those.
CLASSES, FINE = 64, 1024
LONG = 1024
#: Regions of up to so many members are joined without further pivots; of larger ones, members per pivot.
LEAF = 512
PIVOTS = 32
#: Bounds of a group of sets: rows and bytes.
GROUP_ROWS, GROUP_BYTES = 512, 16 << 20
COLUMNS = 8192


# ------------------------------------------------------------------------------- sets

def sets_of(texts: list[str | None], order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Different shingles of all texts in order, their number per text, a hash of each set (0: empty), their places.

    Places are given for an ``Order``: the lower, the rarer a shingle is.
    """
    hashes, counts = word_hashes([t or "" for t in texts])
    found, per = windows(hashes, counts, WIDTH)
    if order is not None:
        words = order.words[_word_counter(hashes)]
        words = sum(words[j:len(words) - WIDTH + 1 + j] for j in range(WIDTH))
    starts = np.cumsum(counts) - counts
    parts, places, at = [np.zeros(0, "u8")], [np.zeros(0, "i8")], 0
    sizes, nodes = np.zeros(len(texts), "i8"), np.zeros(len(texts), "u8")
    for i, n in enumerate(per):
        if n:
            part, first = np.unique(found[at:at + n], return_index=True)
            parts.append(part)
            sizes[i] = len(part)
            nodes[i] = mix(np.array([np.add.reduce(mix(part ^ np.uint64(0x5DEECE66D)))]))[0] or 1
            if order is not None:
                level = order.levels[_counter(part)].astype("i8") << 32
                places.append(level + words[starts[i] + first] if counts[i] >= WIDTH else level)
            at += n
    return np.concatenate(parts), sizes, nodes, None if order is None else np.concatenate(places)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield from text_blocks(batch.set_column(at, "text", pc.ascii_lower(batch.column(at))), "text")


def _counter(found: np.ndarray) -> np.ndarray:
    return (found % np.uint64(COUNTERS)).astype("i8")


def _word_counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype("i8")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, words = np.zeros(COUNTERS, "i8"), np.zeros(1 << WORD_BITS, "i8")
    for _, texts in _texts(batches):
        hashes, counts = word_hashes([t or "" for t in texts])
        np.add.at(words, _word_counter(hashes), 1)
        total += np.bincount(_counter(windows(hashes, counts, WIDTH)[0]), minlength=COUNTERS)
    every = np.concatenate([total, words])
    hit = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype("i4")), pa.array(every[hit])], names=["counter", "n"])


class Order:
    """The global order of shingles, from rare to frequent.

    Shingles whose own count stands out come last, by powers of two.  Most counts do not, as the rare shingles of a
    large corpus fill every counter; those are ordered by the frequency of their words.
    """

    def __init__(self, counts: np.ndarray):
        own, words = counts[:COUNTERS], counts[COUNTERS:]
        usual = 1.5 * max(1.0, own.mean())
        self.levels = np.floor(np.log2(np.maximum(1.0, own / usual))).astype("u1")
        self.words = np.round(64 * np.log2(words + 1.0)).astype("i4")


def shingle_order(keyed: DataFrame) -> Order:
    """The order by hashed counts, from all documents."""
    counted = keyed.select("text").transform(bounded).mapInArrow(_count, "counter int, n bigint").groupBy("counter").agg(
        F.sum("n").alias("n")).toArrow()  # a row per counter at most
    n = np.zeros(COUNTERS + (1 << WORD_BITS), "i8")
    n[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    return Order(n)


def first_shingles(found: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set whose regions can hold a partner: those before which few enough others stand."""
    most = len(found) * (100 - percent) // 100 + 1
    return found[np.lexsort((found, place))[:most]]


def short_vectors(found: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Intersection sizes with the pivot sets, cut at 65,535 (which brings no two sets further apart)."""
    place = (mix(found) >> np.uint64(54)).astype("i8")
    out = []
    for n, end in zip(sizes, np.cumsum(sizes)):
        part = np.bincount(place[end - n:end], minlength=FINE)
        part = part if n >= LONG else part.reshape(CLASSES, -1).sum(axis=1)
        out.append(np.minimum(part, 65535).astype("<u2"))
    return out


def _sign(batches: Iterator[pa.RecordBatch], order, percent: int) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches):
        found, sizes, nodes, place = sets_of(texts, order.value)
        short = short_vectors(found, sizes)
        ends = np.cumsum(sizes)
        regions = [first_shingles(found[b - n:b], place[b - n:b], percent).view("i8") if n else None
                   for b, n in zip(ends, sizes)]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(part.schema.get_field_index(c)) for c in ("id", "k1", "k2")), pa.array(nodes.view("i8")),
             pa.array(sizes), pa.array([x.tobytes() for x in short], pa.binary()),
             pa.array(regions, pa.list_(pa.int64()))],
            names=["id", "k1", "k2", "node", "size", "short", "regions"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches):
        found, sizes, _, _ = sets_of(texts)
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("node")),
             pa.array([found[b - n:b].tobytes() for b, n in zip(ends, sizes)], pa.binary())], names=["node", "vec"])


# ------------------------------------------------------------------- comparisons in a task

class Shorts:
    """Short vectors of a column."""

    def __init__(self, column: pa.Array):
        ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", "<u2")
        width = np.diff(ends) // 2
        self.long = width == FINE
        self.place = np.zeros(len(width), "i8")
        at = ends[:-1].astype("i8") // 2
        self.fine = data[at[self.long][:, None] + np.arange(FINE)]
        self.place[self.long] = np.arange(self.long.sum())
        self.coarse = np.empty((len(width), CLASSES), "i4")
        self.coarse[~self.long] = data[at[~self.long][:, None] + np.arange(CLASSES)]
        self.coarse[self.long] = self.fine.reshape(-1, CLASSES, FINE // CLASSES).sum(axis=2)


def may_link(a: Shorts, b: Shorts, i: np.ndarray, j: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int
             ) -> np.ndarray:
    """Which pairs (i of a, j of b) sizes and short vectors do not rule out."""
    ok = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    most = (100 - percent) * (size_a + size_b)
    for wide in (False, True):
        some = np.flatnonzero(ok)
        if wide:
            some = some[a.long[i[some]] & b.long[j[some]]]
        for part in np.array_split(some, -(-len(some) // (1024 if wide else 16384))) if len(some) else []:
            x, y = ((a.fine[a.place[i[part]]], b.fine[b.place[j[part]]]) if wide
                    else (a.coarse[i[part]], b.coarse[j[part]]))
            ok[part] = (100 + percent) * np.abs(x.astype("i4") - y).sum(axis=1) <= most[part]
    return ok


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(shared: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (size_a + size_b - shared)


def common_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of one list with all of another."""
    sets = left + right
    every = np.concatenate([np.zeros(0, "u8"), *sets])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(every, return_inverse=True, return_counts=True)
    many = times > 1
    keep = many[code]
    place, row = (np.cumsum(many) - 1)[code[keep]], row[keep]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(left), len(right)))
    width = int(many.sum())
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(place, [at, at + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, width - at)), "f4")
        x[row[a:b], place[a:b] - at] = 1.0
        out += x[:len(left)] @ x[len(left):].T
    return out.astype("i8")


def _sides(group: pa.Table) -> tuple[pa.Table, int, bool]:
    """Rows by side, the number of rows of the first, and whether the block meets itself."""
    group = group.take(pc.sort_indices(group["side"]))
    n = pc.sum(pc.equal(group["side"], 0).cast(pa.int32())).as_py() or 0
    return group, n, n == group.num_rows


# -------------------------------------------------------------------------- steps of the join

def _placed(members: DataFrame) -> DataFrame:
    """Members of a region as blocks against blocks: (region, i, j), side."""
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("bytes") * 8 / GROUP_BYTES))
    sizes = sizes.select("region", blocks.cast("int").alias("blocks"))
    put = members.join(sizes, "region").withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return put.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      (F.col("own") > F.col("other")).cast("int").alias("side"))


def _partners(percent: int):
    """Members of a block that a member of another component may be linked with."""
    def run(group: pa.Table) -> pa.Table:
        group, n, alone = _sides(group)
        short, size = Shorts(group["short"].combine_chunks()), group["size"].to_numpy()
        comp = group["comp"].to_numpy()
        some = np.zeros(group.num_rows, bool)
        others = np.arange(group.num_rows) if alone else np.arange(n, group.num_rows)
        for at in range(0, n, 64):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + 64, n)), others, indexing="ij"))
            apart = (comp[i] != comp[j]) & (i < j)
            i, j = i[apart], j[apart]
            hit = may_link(short, short, i, j, size[i], size[j], percent)
            some[i[hit]] = some[j[hit]] = True
        return group.select(["region", "node", "size", "comp"]).filter(pa.array(some))
    return run


def _leaf(percent: int):
    """A forest of links between different components of a block."""
    def run(group: pa.Table) -> pa.Table:
        group, n, alone = _sides(group)
        node, comp, size = (group[c].to_numpy() for c in ("node", "comp", "size"))
        sets = [np.frombuffer(v, "u8") for v in group["vec"].to_pylist()]
        others = np.arange(len(sets)) if alone else np.arange(n, len(sets))
        found = []
        if n and len(others):
            shared = common_matrix(sets[:n], [sets[j] for j in others])
            hit = links(shared, size[:n, None], size[others], percent) & (comp[:n, None] != comp[others])
            root = {c: c for c in comp.tolist()}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c
            for i, j in np.argwhere(hit).tolist():
                x, y = top(int(comp[i])), top(int(comp[others[j]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((node[i], node[others[j]]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})
    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, last, vec = [], None, None
            for i in range(batch.num_rows):
                center = batch.column(0)[i].as_py()
                if center != last:
                    last, vec = center, np.frombuffer(batch.column(2)[i].as_py(), "u8")
                other = np.frombuffer(batch.column(3)[i].as_py(), "u8")
                if links(common(vec, other), len(vec), len(other), percent):
                    hits.append(i)
            yield batch.take(pa.array(hits, pa.int64())).select(["a", "b"])
    return run


def _possible(percent: int):
    """Pairs with sizes and short vectors to the pairs that these do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                ok = may_link(Shorts(batch.column(2)), Shorts(batch.column(3)), every, every,
                              batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def _regions(nodes: DataFrame) -> DataFrame:
    """Regions of two or more nodes with different members: (region, n, node).

    Members of regions of two or three follow from what is aggregated; only rows of larger regions, by a Bloom filter,
    are shuffled once more.  Documents that share one shingle often share many: one region of each kind is enough.
    """
    rows = nodes.select("node", F.explode("regions").alias("region"))
    crowd = stored(rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor("node").alias("all")).where("n > 1"), "jaccard-crowd")
    middle = F.when(F.col("n") == 3, F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high")))
    few = crowd.where("n <= 3").select("n", "low", "high", middle.alias("middle")).distinct().select(
        F.xxhash64("low", "middle", "high").alias("region"), "n",
        F.explode(F.filter(F.array("low", "middle", "high"), lambda x: x.isNotNull())).alias("node"))
    many = stored(crowd.where("n > 3").groupBy("n", "low", "high", "all").agg(F.min("region").alias("region")).select(
        "region", "n"), "jaccard-many")
    bloom, blocks = repeat_filter(many, "region", many.count(), 1)
    met = maybe_repeated(rows, "region", bloom, blocks, "met").where("met").select("region", "node").join(many, "region")
    return stored(few.unionByName(met.select("region", "n", "node")), "jaccard-regions")


def _sets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, vec) of the wanted nodes; texts that a Bloom filter rules out are not shuffled."""
    wanted = stored(wanted, "jaccard-wanted")
    bloom, blocks = repeat_filter(wanted.select("k1"), "k1", wanted.count(), 1)
    texts = maybe_repeated(keyed, "k1", bloom, blocks, "hit").where("hit").drop("hit")
    return stored(texts.join(wanted, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text")
                  .transform(bounded).mapInArrow(_vectors, "node bigint, vec binary"), "jaccard-sets")


def _distances(group_key, members: pa.Table, pivots: pa.Table) -> pa.Table:
    """Distances of a part of a region from its pivots."""
    sets = [np.frombuffer(v, "u8") for v in members["vec"].to_pylist()]
    pivots = pivots.take(pc.sort_indices(pivots["node"]))
    centers = [np.frombuffer(v, "u8") for v in pivots["vec"].to_pylist()]
    shared = common_matrix(sets, centers) if sets and centers else np.zeros((len(sets), len(centers)))
    total = np.array([len(s) for s in sets])[:, None] + np.array([len(c) for c in centers])[None, :]
    apart = 1.0 - shared / np.maximum(1, total - shared)
    return pa.table({"region": members["region"], "node": members["node"], "size": members["size"],
                     "comp": members["comp"], "n": members["n"], "d": pa.array(list(apart), pa.list_(pa.float64())),
                     "home": pa.array(apart.argmin(axis=1).astype("i4") if apart.size else np.zeros(len(sets), "i4"))})


def split(members: DataFrame, sets: DataFrame, percent: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Members (region, node, size, comp, n) of large regions, in the regions of document pivots; those that stay.

    Where members are at like distances from each other, most go into most regions.  New regions are counted before
    members are written out to them, and a region stays whole if they would leave half of its pairs or more.
    """
    by_hash = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(depth)))
    pivots = stored(members.withColumn("p", F.row_number().over(by_hash)).where(F.col("p") <= PIVOTS).select(
        "region", "node"), "jaccard-pivots")
    widths = members.groupBy("region").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / GROUP_ROWS), F.ceil(F.sum("size") * 8 / GROUP_BYTES)).cast("int").alias("parts"))
    dealt = members.join(widths, "region").withColumn(
        "part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")).join(sets, "node")
    around = pivots.join(widths, "region").join(sets, "node").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *(F.col(c).alias(c) for c in ("region", "part", "node", "vec")))
    away = stored(dealt.groupBy("region", "part").cogroup(around.groupBy("region", "part")).applyInArrow(
        _distances, "region long, node long, size long, comp long, n long, d array<double>, home int"), "jaccard-distances")
    radius = away.groupBy("region", "home").agg(F.max(F.element_at("d", F.col("home") + 1)).alias("r")).groupBy(
        "region").agg(F.map_from_entries(F.collect_list(F.struct("home", "r"))).alias("radius"))  # PIVOTS at most
    e, tiny = (100 - percent) / 100, 1e-9
    far = away.join(radius, "region").select("*", F.posexplode("d").alias("q", "dq")).where(
        (F.col("q") == F.col("home")) | (
            (F.col("q") > F.col("home")) & (F.col("dq") <= F.element_at("d", F.col("home") + 1) + 2 * e + tiny)
            & (F.col("dq") <= F.element_at("radius", F.col("q")) + e + tiny)))
    # Regions of two components or more, as in _open.
    made = stored(far.groupBy("region", "q").agg(
        F.count(F.lit(1)).alias("n"), F.first("n").alias("before"), F.min("comp").alias("low"),
        F.max("comp").alias("high")).where("low <> high").select("region", "q", "n", "before"), "jaccard-made")
    pairs = made.groupBy("region").agg(
        F.sum(F.col("n").cast("double") * F.col("n")).alias("left"),
        F.first("before").cast("double").alias("all"))
    stays = stored(pairs.where(2 * F.col("left") > F.col("all") * F.col("all")).select("region"), "jaccard-whole")
    made = made.join(stays, "region", "left_anti").select("region", "q", F.col("n").alias("now"))
    # Members of regions that stay are dropped before they are written out.
    apart = far.join(stays, "region", "left_anti").join(made, ["region", "q"])
    return (apart.select(F.xxhash64("region", "q", F.lit(depth)).alias("region"), "node", "size", "comp",
                         F.col("now").alias("n")),
            members.join(stays, "region", "left_semi"))


def _open(members: DataFrame) -> DataFrame:
    """Members of regions with two components or more, and their number ``n``."""
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"),
                                          F.max("comp").alias("high")).where("low <> high")
    return members.join(sizes.select("region", "n"), "region")


def _of_like_size(members: DataFrame, percent: int) -> DataFrame:
    """Members with another component's member of like size in their region.

    The empty set is the pivot: its distances are the sizes, and classes of sizes are the rings around it.  Linked
    sets are in the same ring or in neighbouring ones.
    """
    members = members.withColumn("ring", F.floor(F.log("size") / (math.log(100 / percent) * (1 + 1e-9))).cast("int"))
    rings = members.groupBy("region", "ring").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    near = rings.select("region", F.explode(F.array(F.col("ring") - 1, "ring", F.col("ring") + 1)).alias("ring"),
                        "low", "high").groupBy("region", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    kept = near.where("low <> high").select("region", "ring")
    return members.join(kept, ["region", "ring"], "left_semi").drop("ring")


def _joined(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return stored(_placed(members.select("region", "node", "size", "comp")).join(sets, "node").groupBy(
        "region", "i", "j").applyInArrow(_leaf(percent), "a bigint, b bigint"), "jaccard-links")


def linked_nodes(keyed: DataFrame, signed: DataFrame, percent: int, leaf: int = LEAF) -> DataFrame:
    """Verified links (a, b) that connect the nodes of each component."""
    nodes = stored(signed.where("node <> 0").groupBy("node").agg(
        F.min(F.struct("k1", "k2")).alias("rep"), F.first("size").alias("size"), F.first("short").alias("short"),
        F.first("regions").alias("regions")), "jaccard-nodes")
    facts = nodes.select("node", "size", "short", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))
    sizes = facts.select("node", "size")
    regions = _regions(nodes)

    # Pairs that are alone in a region, and every node against the center that it meets most often.
    company = regions.groupBy("node").agg(F.sum("n").alias("company"))
    centers = regions.join(company, "node").groupBy("region").agg(
        F.max(F.struct("company", "node")).alias("best")).select("region", F.col("best.node").alias("center"))
    stars = stored(regions.join(centers, "region").where("node <> center").groupBy(
        F.col("center").alias("a"), F.col("node").alias("b")).agg(
        F.max(F.col("n") == 2).alias("two"), F.count(F.lit(1)).alias("met")), "jaccard-met")
    best = stars.where("not two").groupBy("b").agg(F.max(F.struct("met", "a")).alias("best"))
    stars = stars.where("two").select("a", "b").unionByName(best.select(F.col("best.a").alias("a"), "b"))
    known = facts.select("node", "short", "size")
    for side in "ab":
        stars = stars.join(sizes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}")), side)
    stars = stars.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    for side in "ab":
        stars = stars.join(known.select(F.col("node").alias(side), F.col("short").alias(f"short_{side}")), side)
    stars = stored(stars.select("a", "b", "short_a", "short_b", "size_a", "size_b").transform(bounded).mapInArrow(
        _possible(percent), "a bigint, b bigint"), "jaccard-stars")
    keys = facts.select("node", "k1", "k2")
    sets = _sets(keyed, keys.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"))
    both = stars.join(sets.select(F.col("node").alias("b"), F.col("vec").alias("vec_b")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("vec").alias("vec_a")), "a")
    first = stored(both.select("a", "b", "vec_a", "vec_b").transform(bounded).mapInArrow(
        _verify(percent), "a bigint, b bigint"), "jaccard-links")

    # What pivots of one shingle have left together and not connected; two members have met already.
    state = regions.where("n > 2").select("region", "node").join(components(first), "node", "left").join(
        sizes, "node").select("region", "node", F.coalesce("root", "node").alias("comp"), "size")
    state = _of_like_size(stored(_open(state).drop("n"), "jaccard-state"), percent)
    rest = _placed(state).join(facts.select("node", "short"), "node").groupBy("region", "i", "j").applyInArrow(
        _partners(percent), "region long, node long, size long, comp long")
    rest = stored(_open(rest.distinct()), "jaccard-rest")
    done = [first]
    if not rest.isEmpty():
        sets = _sets(keyed, keys.join(rest.select("node").distinct(), "node"))
        depth, small = 0, F.col("n") <= leaf
        done.append(_joined(rest.where(small), sets, percent))
        large = rest.where(~small)
        while not large.isEmpty():
            depth += 1
            made, whole = split(large, sets, percent, depth)
            made = stored(made, "jaccard-split")
            done.append(_joined(made.where(small).unionByName(whole.select(*made.columns)), sets, percent))
            large = made.where(~small)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT,
         leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links)."""
    need(docs, id_col, text_col)
    i, t = F.col(id_col), F.col(text_col)
    keyed = docs.select(i.alias("id"), t.alias("text"), F.xxhash64(i, t).alias("k1"),
                        F.xxhash64(F.lit(1), i, t).alias("k2"))
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(keyed))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stored(keyed.transform(bounded).mapInArrow(
        lambda b: _sign(b, order, percent),
        f"id {kind}, k1 bigint, k2 bigint, node bigint, size bigint, short binary, regions array<bigint>"), "jaccard-signed")
    labels = components(linked_nodes(keyed, signed, percent, leaf))
    # Names are found on nodes, so copies meet their component's name by one narrow join.
    least = signed.where("node <> 0").groupBy("node").agg(F.min("id").alias("least"))  # min skips nulls
    named = least.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "node", "component_id")
    rows = signed.select("id", "node", F.col("size").alias("n_shingles"))
    found = rows.where("node <> 0").join(names, "node").select("id", "n_shingles", "component_id")
    blank = rows.where("node = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.unionByName(blank).withColumnRenamed("id", id_col)


@query("op13_jaccard_join", r"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN text_words = 0 THEN [] WHEN text_words < 3 THEN [array_to_string(words, ' ')]
          ELSE list_transform(generate_series(1, text_words - 2),
                              lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles
      FROM (SELECT *, coalesce(len(words), 0) AS text_words FROM w)),
e AS (SELECT r, unnest(shingles) AS shingle FROM s),
f AS (SELECT shingle FROM e GROUP BY shingle HAVING count(*) > 1),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS shared
          FROM e a JOIN f USING (shingle) JOIN e b USING (shingle) WHERE a.r <> b.r GROUP BY ALL),
links AS MATERIALIZED (
    SELECT p.a, p.b FROM pairs p JOIN s x ON x.r = p.a JOIN s y ON y.r = p.b
    WHERE 100 * shared >= 90 * (len(x.shingles) + len(y.shingles) - shared)),
reach AS (SELECT * FROM (
    WITH RECURSIVE go(r, other) AS (
        SELECT r, r FROM s UNION SELECT go.r, links.b FROM go JOIN links ON links.a = go.other)
    SELECT * FROM go))
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.shingles)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN s ON s.r = reach.r JOIN s o ON o.r = reach.other GROUP BY s.r""")
def op13(spark, sf_dir):
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
