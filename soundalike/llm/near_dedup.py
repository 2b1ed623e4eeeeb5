"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

Texts are sets of five-word shingles with weights: occurrences in the text times ``1 + idf``, idf scaled to
[0, 1].  Document frequencies are counted over all documents in ``DF_BUCKETS`` hashed counters, so the table of
counts has a fixed size; a shingle's share of documents is off by at most the share that falls on one counter,
whatever the size of the corpus.  The offset keeps the largest ratio of two weights at two: within a large
group of near copies the shared shingles are frequent and the edits rare, and a bare idf would count the edits
many times over.

Each text gets ``BANDS * ROWS`` samples whose chance of agreeing between two texts is their weighted Jaccard
similarity, and ``PLAIN_BANDS * ROWS`` of which it is that of the plain sets: both arms of the rule below have
candidates.  Texts that agree on all rows of a band share a bucket.  Two rounds of exact verification follow:

1. every text of a bucket against one text of it, the one with most company in all its buckets;
2. in buckets whose texts are not yet all connected, every text against every other in another component, in
   blocks of ``BLOCK_ROWS`` by ``BLOCK_ROWS`` as matrix products; a block returns no more rows than it has texts.

No bucket is capped and no pair within a group is emitted; a bucket that one text of it connects costs one
comparison per text.  Two texts are linked if the weighted Jaccard similarity, or that of the plain shingle
sets, is ``THRESHOLD`` or more.  Classes are the connected components.  Word sequences that are equal are one
node of the graph from the start, so a text copied a million times is compared once.

Defined results: texts without words (null, empty, blank) are near no other text and are classes of their own;
a text of one to four words has one shingle of all its words.  Of a class the smallest id stays (null ids
last), and of rows equal in id and text one.  Very long texts are read whole.  Empty tables give no rows.
Extra columns are carried along by ``drop_near_copies``.  Nodes are 64-bit hashes of word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, need, per_process, private, query, stored, table
from soundalike.llm.components import components
from soundalike.llm.exact_dedup import maybe_repeated, repeat_filter
from soundalike.llm.kernels import mix, text_blocks, windows, word_hashes

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: Further bands over the plain sets, for pairs that only their plain similarity links.
PLAIN_BANDS = 10
#: Hashed counters of document frequencies; they are collected and broadcast, 2 MB whatever the input.
DF_BUCKETS = 1 << 18
#: Shares of documents below this one weigh the same.
RAREST = 1 / 2048
#: Entries of the table of random values that shingles draw from, one draw per sample.
POOL = 1 << 16
#: Bounds of a block of vectors: rows and bytes.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
COLUMNS = 4096

ENTRY = np.dtype([("h", "<u8"), ("w", "<f4"), ("n", "<u4")])


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text in order, their occurrences, their number per text; sequence hashes.

    The hash of a text's word sequence is 0 for texts without words.
    """
    hashes, counts = word_hashes([t or "" for t in texts])
    found, per = windows(hashes, counts, WIDTH)
    parts, times, sizes = [], [], np.zeros(len(texts), "i8")
    at = 0
    for i, n in enumerate(per):
        if n:
            part, k = np.unique(found[at:at + n], return_counts=True)
            parts.append(part)
            times.append(k)
            sizes[i] = len(part)
            at += n
    nodes = np.zeros(len(texts), "u8")
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.cumsum(counts) - counts
        place = (np.arange(len(hashes)) - np.repeat(starts, counts)).astype("u8")
        nodes[some] = mix(np.add.reduceat(mix(hashes ^ mix(place + np.uint64(7))), starts[some]))
    empty = np.zeros(0, "u8")
    return (np.concatenate(parts) if parts else empty, np.concatenate(times) if times else empty.astype("i8"),
            sizes, nodes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of one task, by hashed counter."""
    total = np.zeros(DF_BUCKETS, "i8")
    for batch in batches:
        for _, texts in text_blocks(batch, "text"):
            found = shingles(texts)[0]
            total += np.bincount((found % np.uint64(DF_BUCKETS)).astype("i8"), minlength=DF_BUCKETS)
    hit = np.flatnonzero(total)
    for part in np.array_split(hit, -(-len(hit) // 50_000)) if len(hit) else []:
        yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array(total[part])],
                                         names=["counter", "n"])


def shingle_weights(docs: DataFrame) -> np.ndarray:
    """Weight of a shingle by hashed counter, from all documents."""
    counted = docs.select("text").transform(bounded).mapInArrow(_count, "counter int, n bigint").groupBy("counter").agg(
        F.sum("n").alias("n")).toArrow()  # DF_BUCKETS rows at most
    n_docs = max(1, docs.count())
    share = np.full(DF_BUCKETS, RAREST)
    share[counted["counter"].to_numpy()] = np.clip(counted["n"].to_numpy() / n_docs, RAREST, 1.0)
    return (1.0 + np.log1p(1 / share) / np.log1p(1 / RAREST)).astype("f4")


def _make_pool() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240229)
    r, c = rng.gamma(2.0, 1.0, POOL), rng.gamma(2.0, 1.0, POOL)
    return tuple(x.astype("f4") for x in (r, 1 / r, np.log(c) - r, rng.random(POOL)))


def samples(found: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, one row per text that has shingles."""
    r, inverse, start_value, shift = per_process("draws", _make_pool)
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    logs = np.log(weights).astype("f4")
    out = np.empty((len(sizes), BANDS * ROWS), "u8")
    for k in range(BANDS * ROWS):
        draw = ((found * np.uint64(2 * (k * 0x5851F42D4C957F2D % (1 << 62)) + 1)) >> np.uint64(48)).astype("i4")
        beta = shift.take(draw)
        step = np.floor(logs * inverse.take(draw) + beta)
        value = start_value.take(draw) - r.take(draw) * (step - beta)
        best = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), sizes))
        owner = text[best]
        best = best[np.concatenate(([True], owner[1:] != owner[:-1]))]
        out[:, k] = mix(found[best] ^ mix(step[best].astype("i8").view("u8") + np.uint64(k)))
    return out


def plain_samples(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minima of hashed shingles, one row per text that has shingles; how often a shingle occurs does not count."""
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), PLAIN_BANDS * ROWS), "u8")
    for k in range(PLAIN_BANDS * ROWS):
        # Shingles are hashes already; an odd factor, the high half folded down and another one order them anew.
        x = found * np.uint64(2 * (k * 0x2545F4914F6CDD1D % (1 << 62)) + 0x9E3779B1)
        out[:, k] = np.minimum.reduceat((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), starts)
    return out


def buckets_of(drawn: np.ndarray, bands: int, first: int) -> np.ndarray:
    """One bucket per band of ``ROWS`` samples; bands are numbered from ``first``."""
    drawn = drawn.reshape(-1, bands, ROWS)
    joined = np.zeros(drawn.shape[:2], "u8") + np.arange(first, first + bands, dtype="u8")
    for j in range(ROWS):
        joined = mix(joined * np.uint64(31) ^ drawn[:, :, j])
    return joined


def _sign(batches: Iterator[pa.RecordBatch], weight_of) -> Iterator[pa.RecordBatch]:
    names = ["id", "k1", "k2"]
    for batch in batches:
        for part, texts in text_blocks(batch, "text"):
            found, times, sizes, nodes = shingles(texts)
            buckets = [None] * len(texts)
            if len(found):
                weight = weight_of()[(found % np.uint64(DF_BUCKETS)).astype("i8")]
                joined = np.concatenate([buckets_of(samples(found, weight * times, sizes), BANDS, 0),
                                         buckets_of(plain_samples(found, sizes), PLAIN_BANDS, BANDS)], axis=1)
                for i, row in zip(np.flatnonzero(sizes), joined.view("i8")):
                    buckets[i] = row
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(nodes.view("i8")),
                 pa.array(buckets, pa.list_(pa.int64()))], names=[*names, "node", "buckets"])


def _vectors(batches: Iterator[pa.RecordBatch], weight_of) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, vec): shingles in order with weight per occurrence and occurrences."""
    for batch in batches:
        for part, texts in text_blocks(batch, "text"):
            found, times, sizes, _ = shingles(texts)
            entries = np.empty(len(found), ENTRY)
            entries["h"], entries["n"] = found, times
            entries["w"] = weight_of()[(found % np.uint64(DF_BUCKETS)).astype("i8")]
            ends = np.cumsum(sizes)
            data = [entries[b - n:b].tobytes() for b, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("node")), pa.array([len(x) for x in data], pa.int64()),
                 pa.array(data, pa.binary())], names=["node", "bytes", "vec"])


def similar(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of weighted and plain Jaccard similarity of two vectors."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b["h"], a["h"])
    at[at == len(b)] = 0
    same = b["h"][at] == a["h"]
    left, right = a[same], b[at[same]]
    shared = float((left["w"] * np.minimum(left["n"], right["n"])).sum())
    both = float((a["w"] * a["n"]).sum() + (b["w"] * b["n"]).sum())
    plain = len(left) / max(1, len(a) + len(b) - len(left))
    return max(shared / max(1e-9, both - shared), plain)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        last, vec = None, None
        for i in range(batch.num_rows):
            center = batch.column(0)[i].as_py()
            if center != last:
                last, vec = center, np.frombuffer(batch.column(2)[i].as_py(), ENTRY)
            if similar(vec, np.frombuffer(batch.column(3)[i].as_py(), ENTRY)) >= THRESHOLD:
                hits.append(i)
        yield batch.take(pa.array(hits, pa.int64())).select(["a", "b"])


def _matrix(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle occurrences of all vectors: row, element, weight, whether it is the first occurrence."""
    sizes = [int(v["n"].sum()) for v in vectors]
    every = np.concatenate(vectors) if vectors else np.zeros(0, ENTRY)
    n = every["n"].astype("i8")
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    element = np.repeat(every["h"], n)
    element = np.where(nth == 0, element, mix(element + nth.astype("u8")))
    return np.repeat(np.arange(len(vectors)), sizes), element, np.repeat(every["w"], n), nth == 0


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix: which vectors of ``left`` are similar to which of ``right``."""
    both = _matrix(left + right)
    row, element, weight, first = both
    unique, code = np.unique(element, return_inverse=True)
    many = np.bincount(code) > 1
    total = np.bincount(row, weights=weight, minlength=len(left) + len(right))
    sets = np.bincount(row, weights=first, minlength=len(left) + len(right))
    keep = many[code]
    place = np.cumsum(many) - 1
    row, code, weight, first = row[keep], place[code[keep]], weight[keep], first[keep]
    order = np.argsort(code, kind="stable")
    row, code, weight, first = row[order], code[order], weight[order], first[order]
    shape = (len(left), len(right))
    shared, plain = np.zeros(shape, "f8"), np.zeros(shape, "f8")
    width = int(many.sum())
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(code, [at, at + COLUMNS])
        x = np.zeros((len(left) + len(right), min(COLUMNS, width - at)), "f4")
        x[row[a:b], code[a:b] - at] = 1.0
        w = np.zeros(x.shape[1], "f4")
        w[code[a:b] - at] = weight[a:b]
        once = np.zeros(x.shape[1], "f4")
        once[code[a:b] - at] = first[a:b]
        shared += (x[:len(left)] * w) @ x[len(left):].T
        plain += (x[:len(left)] * once) @ x[len(left):].T
    n = len(left)
    j = shared / np.maximum(1e-9, total[:n, None] + total[None, n:] - shared)
    p = plain / np.maximum(1, sets[:n, None] + sets[None, n:] - plain)
    return np.maximum(j, p) >= THRESHOLD


def _block(group: pa.Table) -> pa.Table:
    """Links of one block between texts of different components, as a star per connected set."""
    node, comp = group["node"].to_numpy(), group["comp"].to_numpy()
    side = group["side"].to_numpy()
    order = np.argsort(side, kind="stable")
    node, comp, side = node[order], comp[order], side[order]
    vectors = [np.frombuffer(group["vec"][int(i)].as_py(), ENTRY) for i in order]
    n = int((side == 0).sum())
    inside = not (side == 1).any()  # a block against itself
    rows = np.arange(len(node))
    a, b = (rows, rows) if inside else (rows[:n], rows[n:])
    if len(a) and len(b):
        hit = linked([vectors[i] for i in a], [vectors[i] for i in b]) & (comp[a][:, None] != comp[b][None, :])
        pairs = np.argwhere(hit)
    else:
        pairs = np.zeros((0, 2), "i8")
    root = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c
    found = []
    for i, j in pairs.tolist():
        x, y = top(int(comp[a[i]])), top(int(comp[b[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((node[a[i]], node[b[j]]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                     "b": pa.array([y for _, y in found], pa.int64())})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(i.alias("id"), t.alias("text"), F.xxhash64(i, t).alias("k1"),
                       F.xxhash64(F.lit(1), i, t).alias("k2"))


def _shared_table(spark, values: np.ndarray):
    """A broadcast table; the function gives it inside a task."""
    held = spark.sparkContext.broadcast(values)
    return lambda: held.value


def links(keyed: DataFrame, signed: DataFrame, weight_of) -> DataFrame:
    """Verified links (a, b) that connect the nodes of each class."""
    nodes = signed.where("node <> 0").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")).alias("rep"),
        F.first("buckets").alias("buckets"))
    rows = nodes.select("node", "rep.k1", "rep.k2", F.explode("buckets").alias("bucket"))
    sizes = rows.groupBy("bucket").count().where("count > 1")
    shared = stored(rows.join(sizes, "bucket"), "near-buckets")
    company = shared.groupBy("node").agg(F.sum("count").alias("company"))
    centers = shared.join(company, "node").groupBy("bucket").agg(
        F.max(F.struct("company", "node")).alias("best")).select("bucket", F.col("best.node").alias("center"))
    wanted = stored(shared.select("node", "k1", "k2").distinct(), "near-wanted")
    # Only texts that the Bloom filter lets through are shuffled.
    bloom, blocks = repeat_filter(wanted.select("k1"), "k1", wanted.count(), 1)
    texts = maybe_repeated(keyed, "k1", bloom, blocks, "hit").where("hit").drop("hit")
    vectors = stored(texts.join(wanted, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text")
                     .transform(bounded).mapInArrow(lambda b: _vectors(b, weight_of), "node bigint, bytes bigint, vec binary"), "near-vectors")

    stars = shared.join(centers, "bucket").where("node <> center").select(
        F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    with_b = stars.join(vectors.select(F.col("node").alias("b"), F.col("vec").alias("vec_b")), "b")
    both = with_b.join(vectors.select(F.col("node").alias("a"), F.col("vec").alias("vec_a")), "a")
    first = stored(both.select("a", "b", "vec_a", "vec_b").transform(bounded).mapInArrow(_verify, "a bigint, b bigint"), "near-links")

    labels = components(first)
    state = shared.select("bucket", "node").join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("comp"))
    state = stored(state.join(vectors.select("node", "bytes"), "node"), "near-state")
    open_ = state.groupBy("bucket").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("low <> high")
    # Bands often gather the same texts; one bucket of each kind is enough.
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    open_ = open_.groupBy("n", "members").agg(F.min("bucket").alias("bucket"), F.max(blocks).alias("blocks"))
    placed = state.select("bucket", "node", "comp").join(open_, "bucket")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp",
        (F.col("own") > F.col("other")).cast("int").alias("side"))
    second = placed.join(vectors.select("node", "vec"), "node").groupBy("bucket", "i", "j").applyInArrow(_block, "a bigint, b bigint")
    return first.unionByName(stored(second, "near-links"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of the class), class_size, kept, and the row's keys."""
    need(docs, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col)
    weight_of = _shared_table(docs.sparkSession, shingle_weights(keyed))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stored(keyed.transform(bounded).mapInArrow(
        lambda b: _sign(b, weight_of), f"id {kind}, k1 bigint, k2 bigint, node bigint, buckets array<bigint>"),
        "near-signed")
    rows = stored(signed.select("id", "k1", "k2", "node", F.monotonically_increasing_id().alias("row")),
                  "near-rows")
    labels = components(links(keyed, signed, weight_of))
    some = rows.where("node <> 0").join(labels, "node", "left").withColumn("class", F.coalesce("root", "node"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    classes = some.groupBy("class").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    found = some.join(classes, "class").select(
        "id", F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"),
        "k1", "k2")
    blank = rows.where("node = 0").select(
        "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(True).alias("kept"), "k1", "k2")
    return found.unionByName(blank).withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, columns unchanged; rows that stay are not shuffled."""
    made = stored(decisions(docs, id_col, text_col).select("k1", "k2", "kept"), "near-decisions")
    keys = made.groupBy("k1", "k2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = stored(keys.where("not kept or n > 1"), "near-marked")
    bloom, blocks = repeat_filter(marked, "k1", marked.count(), 1)
    bloom = stored(bloom, "near-bloom")
    a, b, hit, kept, n = (private(x) for x in ("k1", "k2", "hit", "kept", "n"))
    i, t = F.col(id_col), F.col(text_col)
    tested = maybe_repeated(docs.withColumn(a, F.xxhash64(i, t)).withColumn(b, F.xxhash64(F.lit(1), i, t)),
                            a, bloom, blocks, hit)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    facts = marked.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("kept").alias(kept), F.col("n").alias(n))
    met = tested.where(hit).join(facts, [a, b], "left")
    alone = met.where(F.col(kept).isNull()).select(*columns)
    again = met.where(F.col(kept)).dropDuplicates([a, b]).select(*columns)
    return tested.where(~F.col(hit)).select(*columns).unionByName(alone).unionByName(again)


@query("op4_near_dedup")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decisions(docs).drop("k1", "k2")
