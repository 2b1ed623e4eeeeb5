"""Exact dedup with a two-pass Bloom filter, in DataFrame operations only.

Texts are equal when they are identical after deleting white space.  Pass one hashes every text into a
blocked Bloom filter that remembers which positions were set by more than one row; pass two probes it, and
only rows whose positions were all set more than once can have a partner.  Those rows alone are shuffled and
compared by their full SHA-256; the others pass straight through and keep their place.

Defined results: a null text counts as empty, and empty texts are copies of one another.  Of equal texts the
row with the most code points in the original text stays, then the smallest id (null ids last).  Rows repeated
in full, id included, count as copies too and one of them stays.  Very long texts are hashed whole.  Empty
tables give empty results.  Extra columns, whatever their names, are carried along unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.llm.common import SPACES, need, private, query, stored, table, text_of

#: Bits of one block: what Spark's bitmap functions hold in one value of 4 KB.
BLOCK_BITS = 32768
BITS_PER_ROW = 16
#: Bound of the broadcast filter: 16,384 blocks of 4 KB are 64 MB.  Beyond 268 million rows there are fewer
#: bits per row, so more rows are compared by SHA-256; results do not change.
MAX_BLOCKS = 16384


def normalised(text: str | Column) -> Column:
    return F.translate(text_of(text), SPACES, "")


def fingerprint(text: str | Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _places(hashed: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block and two positions in it, from separate parts of two hashes."""
    again = F.xxhash64(F.lit(11), hashed)
    return (F.pmod(hashed, F.lit(blocks)).cast("int"),
            [F.pmod(again, F.lit(BLOCK_BITS)).cast("int"),
             F.pmod(F.shiftrightunsigned(again, 32), F.lit(BLOCK_BITS)).cast("int")])


def repeat_filter(hashes: DataFrame, column: str, rows: int, least: int = 2) -> tuple[DataFrame, int]:
    """The filter of positions that ``least`` rows or more have set: (block, bits), and its number of blocks.

    With ``least`` = 1 it is an ordinary Bloom filter of the hashes.
    """
    blocks = max(1, min(MAX_BLOCKS, -(-rows * BITS_PER_ROW // BLOCK_BITS)))
    block, places = _places(F.col(column), blocks)
    # A row sets a position once, also where its two positions are the same.
    marks = hashes.select(block.alias("block"), F.explode(F.array_distinct(F.array(*places))).alias("place"))
    twice = marks.groupBy("block", "place").count().where(F.col("count") >= least)
    return twice.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")), blocks


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7)) == 1


def maybe_repeated(df: DataFrame, column: str, bloom: DataFrame, blocks: int, mark: str) -> DataFrame:
    """``df`` with a boolean ``mark``: false only for hashes that are surely not in the filter."""
    b, bits = private(f"block_{mark}"), private(f"bits_{mark}")
    block, places = _places(F.col(column), blocks)
    # At most MAX_BLOCKS rows of 4 KB: the bound is proven, whatever the number of documents.
    small = F.broadcast(bloom.select(F.col("block").alias(b), F.col("bits").alias(bits)))
    tested = df.withColumn(b, block).join(small, b, "left")
    hit = F.col(bits).isNotNull()
    for p in places:
        hit = hit & _is_set(F.col(bits), p)
    return tested.withColumn(mark, F.coalesce(hit, F.lit(False))).drop(b, bits)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are read once; what follows works on ids, lengths and hashes.
    """
    need(docs, id_col, text_col)
    narrow = stored(docs.select(
        F.col(id_col).alias("id"), F.char_length(text_of(text_col)).alias("chars"),
        fingerprint(text_col).alias("sha"), F.monotonically_increasing_id().alias("row")), "dedup")
    narrow = narrow.withColumn("h", F.xxhash64("sha"))
    bloom, blocks = repeat_filter(narrow, "h", narrow.count())
    marked = maybe_repeated(narrow, "h", bloom, blocks, "again")
    alone = marked.where(~F.col("again")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    crowd = marked.where("again")
    # Ids may be null or repeated; the row number settles what is left.
    order = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "row")
    best = crowd.groupBy("sha").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    grouped = crowd.join(best, "sha").select(
        "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies, all columns kept.

    Rows that cannot have a partner are never shuffled.  Of the others one row per text and task is left
    before the shuffle (Spark limits ranks map-side), so a text that fills a third of the table is cheap.
    """
    need(docs, id_col, text_col)
    sha, h, again, place = (private(x) for x in ("sha", "hash", "again", "place"))
    hashed = docs.withColumn(sha, fingerprint(text_col)).withColumn(h, F.xxhash64(sha))
    hashes = stored(hashed.select(F.col(h).alias("h")), "dedup-hashes")
    bloom, blocks = repeat_filter(hashes, "h", hashes.count())
    bloom = stored(bloom, "dedup-bloom")
    marked = maybe_repeated(hashed, h, bloom, blocks, again)
    order = Window.partitionBy(sha).orderBy(
        F.char_length(text_of(text_col)).desc(), F.col(id_col).asc_nulls_last())
    crowd = marked.where(again).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return marked.where(~F.col(again)).select(*docs.columns).unionByName(crowd.select(*docs.columns))


@query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op1(spark, sf_dir):
    return decisions(table(spark, sf_dir, "documents"))
