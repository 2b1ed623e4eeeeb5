"""Ranked lexical search with the Best Position Algorithm over impact lists.

Two passes over the documents:

1. every text is cut into terms once; of each document its length and the occurrences of the items' terms are
   written, and from these the number of documents, all terms and document frequencies are counted;
2. each task takes what was written in blocks of up to ``BLOCK_POSTINGS`` postings.  A block has one list per
   term, its documents by falling impact, and for direct access the terms of each document with their positions
   in those lists.  Per item the lists are read side by side; a document seen in one of them gets its whole score
   by direct access, which marks its positions in all the others.  The best position of a list is the last one
   before the first unseen.  A document not seen yet scores no more than the impacts behind the best positions
   together; reading stops when that is strictly below the k-th score.  The k best of earlier blocks stay, so
   later blocks stop sooner or are not read at all.

Documents are never shuffled: a task returns ``items x k`` rows, whatever a term's share of documents.  Items are
taken in blocks of up to ``ITEM_BYTES`` of text, which are broadcast with their vocabulary.

Defined results: a null text has no terms, for documents and items alike.  Scores of 0 are left out.  Equal scores
come by ascending id, null ids last; rows that repeat an id are documents of their own.  Items equal in id and text
are answered once.  Empty tables give no rows; very long texts are read whole; extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, hash_blocks, need, query, stored, table
from soundalike.llm.kernels import LEAST, NO_ID, Best
from soundalike.session import scratch_path

#: Texts of one block of items; a block is collected and broadcast.
ITEM_BYTES = 4 << 20
BLOCK_POSTINGS, BLOCK_DOCS = 2_000_000, 65_536
#: Positions of each list that the first step reads; every further step reads twice as many.
FIRST_STEP = 32
PIECE = 1 << 20

_TERM = [c >= 0x80 or chr(c).isalnum() for c in range(256)]
_FOLD = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if _TERM[c] else 0x20 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and of all else beyond ASCII, A-Z lower-cased."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if len(folded) - at > PIECE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()).fill_null(b"")


def _forward(vocabulary):
    """Task: length and query terms of each document that has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            rows, lengths, terms, times, ends = [], [], [], [], [0]
            for i, item in enumerate(_bytes(batch.column(1))):
                n, found = 0, Counter()
                for words in terms_of(item.as_py()):
                    n += len(words)
                    found.update(map(get, words))
                if n:
                    found.pop(None, None)
                    rows.append(i)
                    lengths.append(n)
                    terms += found.keys()
                    times += found.values()
                    ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))],
                names=["id", "n", "terms", "times"])
    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "i8")
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(total[some])], names=["term", "df"])
    return run


class Lists:
    """Impact lists of a block of documents, and the way back from a document to its positions in them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray,
                 vocabulary: int, n_docs: int, n_terms: int):
        if int(lengths.max(initial=0)) * 75 * n_docs < 1 << 63:
            norm = 25 + 75 * lengths * n_docs // n_terms
        else:
            norm = np.array([25 + 75 * int(n) * n_docs // n_terms for n in lengths], "i8")
        self.ids, self.terms = ids, terms
        self.first = np.cumsum(sizes) - sizes
        self.sizes = sizes
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.impacts = (1_000_000_000 * times) // (1000 * times + 8 * norm[doc])
        order = np.lexsort((-self.impacts, terms))
        self.list_doc, self.list_impact = doc[order], self.impacts[order]
        self.place = np.empty(len(order), "i8")
        self.place[order] = np.arange(len(order))
        self.start = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.seen = np.zeros(len(order) + 1, bool)
        self.scored = np.zeros(len(ids), bool)

    def access(self, docs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole scores of documents, and the positions that they have in all lists."""
        sizes = self.sizes[docs]
        entry = np.arange(sizes.sum()) + np.repeat(self.first[docs] - (np.cumsum(sizes) - sizes), sizes)
        part = weight[self.terms[entry]] * self.impacts[entry]
        total = np.concatenate(([0], np.cumsum(part)))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes], self.place[entry]

    def search(self, item: int, terms: np.ndarray, times: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offer to ``best`` every document that can be among the item's k best."""
        has = self.start[terms + 1] > self.start[terms]
        at, end = self.start[terms[has]], self.start[terms[has] + 1]
        worth = times[has] * weight[terms[has]]
        at, end, worth = at[worth > 0], end[worth > 0], worth[worth > 0]
        asked = np.zeros(len(weight), "i8")
        asked[terms] = times * weight[terms]
        position, read, step, touched = at.copy(), at.copy(), FIRST_STEP, []
        while True:
            inside = position < end
            limit = (worth[inside] * self.list_impact[position[inside]]).sum()
            kth = best.scores[item, -1]
            if not inside.any() or limit < kth or limit <= 0:
                break
            upto = np.minimum(read + step, end)
            docs = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(read, upto)]))
            docs = docs[~self.scored[docs]]
            if len(docs):
                scores, places = self.access(docs, asked)
                self.scored[docs] = self.seen[places] = True
                touched.append((docs, places))
                good = np.flatnonzero((scores >= kth) & (scores > 0))
                if len(good) > best.k:  # what k others of this step surpass need not be sorted
                    edge = np.partition(scores[good], len(good) - best.k)[len(good) - best.k]
                    good = good[scores[good] >= edge]
                best.add(np.full(len(good), item), scores[good], self.ids[docs[good]])
            read, step = upto, 2 * step
            for i in np.flatnonzero(inside):  # the best position moves over what any list has shown
                p, q = position[i], end[i]
                while p < q:
                    part = self.seen[p:min(q, p + 4 * step)]
                    gap = part.argmin()
                    if not part[gap]:
                        p += gap
                        break
                    p += len(part)
                position[i] = p
        for docs, places in touched:
            self.scored[docs] = self.seen[places] = False


def _search(facts, k: int):
    """Task: the k best documents of each item of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_terms = facts.value
        best = Best(len(items), k)
        held, postings, docs = [], 0, 0

        def flush() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = t["terms"].combine_chunks().value_lengths().to_numpy()
            lists = Lists(t["id"].combine_chunks().fill_null(NO_ID).to_numpy(), t["n"].to_numpy(), sizes.astype("i8"),
                          t["terms"].combine_chunks().flatten().to_numpy(),
                          t["times"].combine_chunks().flatten().to_numpy(), len(weight), n_docs, n_terms)
            for i, (terms, times) in enumerate(items):
                if len(terms):
                    lists.search(i, terms, times, weight, best)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                postings += len(batch.column(2).flatten())
                docs += batch.num_rows
            if postings >= BLOCK_POSTINGS or docs >= BLOCK_DOCS:
                flush()
                held, postings, docs = [], 0, 0
        if held:
            flush()
        item, j = np.nonzero(best.scores > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype("i4")), pa.array(best.ids[item, j]),
                                          pa.array(best.scores[item, j])], names=["item", "id", "score"])
    return run


def _of_block(items: pa.Table, docs: DataFrame, k: int, facts_of_item) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    asked = []
    for item in _bytes(items["text"].combine_chunks()):
        found = Counter()
        for words in terms_of(item.as_py()):
            found.update(words)
        asked.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], "i8"),
                      np.array(list(found.values()), "i8")))
    shared = spark.sparkContext.broadcast(vocabulary)
    made = stored(docs.transform(bounded).mapInArrow(
        _forward(shared), "id long, n long, terms array<int>, times array<long>"), "postings")
    n_docs, n_terms = made.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = made.select("terms").mapInArrow(_document_frequencies(len(vocabulary)), "term int, df long").groupBy(
        "term").agg(F.sum("df").alias("df")).toArrow()  # a row per term of the block at most
    weight = np.zeros(max(1, len(vocabulary)), "i8")
    for term, count in zip(df["term"].to_pylist(), df["df"].to_pylist()):
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * count + 1)))
    facts = spark.sparkContext.broadcast((asked, weight, n_docs, int(n_terms or 0)))
    hits = made.transform(bounded).mapInArrow(_search(facts, k), "item int, id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")  # NO_ID is the largest id
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.sparkContext.broadcast(items["id"].combine_chunks())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([ids.value.take(batch.column(0)), *batch.columns[1:]],
                                             names=["item_id", "rank", "doc_id", "score"])
    return ranked.select("item", "rank", "id", "score").mapInArrow(named, facts_of_item)


def rank(items: DataFrame, docs: DataFrame, k: int = 10, *, item_id: str = "item_id", item_text: str = "text",
         doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    A term weighs ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``; a document scores the sum over the item's terms,
    repeats included, of ``w * (10**9 * tf div (1000 * tf + 8 * m))`` with ``m = 25 + 75 * n * N div L``.
    """
    need(items, item_id, item_text)
    need(docs, doc_id, doc_text)
    spark = docs.sparkSession
    asked = stored(items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct(), "items")
    narrow = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"),
                                                            F.col(doc_text).alias("text"))
    found_as = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long"
    parts = hash_blocks(asked, ("id", "text"), F.coalesce(F.octet_length("text"), F.lit(0)) + 64, ITEM_BYTES)
    path, wrote = scratch_path(spark, "llm-lexical-search"), False
    for p in range(parts):
        block = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).toArrow()
        if block.num_rows:
            _of_block(block, narrow, k, found_as).write.mode("append").parquet(path)
            wrote = True
    done = spark.read.schema(found_as).parquet(path) if wrote else spark.createDataFrame([], found_as)
    kind = docs.schema[doc_id].dataType
    return done.withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).cast(kind))


@query("op12_lexical_search", r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf
       FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, s GROUP BY term, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
hits AS (
    SELECT q.item_id, tf.r, tf.doc_id,
           CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * tf.n * s.n_docs) // s.n_terms))))
                AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
ranked AS (
    SELECT item_id, doc_id, score,
           CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM hits WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op12(spark, sf_dir):
    return rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
