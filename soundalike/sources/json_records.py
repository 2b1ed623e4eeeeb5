"""The objects of JSON files that may be one array of any size (inventory A8).

Spark reads such a file in one task.  Here it is read in byte ranges that are cut at every ``}``.  Whether a piece
begins inside a string, and how deep inside objects, depends on all pieces before it: each range is counted for
both cases at once, a running sum over one narrow row per range says which of them holds.  Objects that are one
piece, nearly all, stay where they were read; only pieces of the others are shuffled and put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = "file string, block long, nth long, piece string, quotes long, open0 long, open1 long"
STATE = "before long, depth0 long, depth1 long, after0 long, after1 long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes and depth before each piece of its range, if that begins outside (0) or inside (1) a string."""
    last, held = None, (0, 0, 0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        quotes = batch.column("quotes").to_numpy()
        opened = [batch.column(c).to_numpy() for c in ("open0", "open1")]
        turns = [i for i in range(n) if (files[i], blocks[i]) != ((files[i - 1], blocks[i - 1]) if i else last)]
        before, depth, after = np.zeros(n, np.int64), np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
        for start, end in zip([0, *turns], [*turns, n]):
            if start == end:
                continue
            if start in turns:
                held = (0, 0, 0)
            at = slice(start, end)
            upto = np.cumsum(quotes[at]) + held[0]
            before[at] = upto - quotes[at]
            for p in (0, 1):
                inside = (before[at] + p) % 2 == 1
                change = np.where(inside, opened[1][at], opened[0][at]) - ((upto + p) % 2 == 0)
                after[p, at] = np.cumsum(change) + held[1 + p]
                depth[p, at] = after[p, at] - change
            held = (int(upto[-1]), int(after[0, end - 1]), int(after[1, end - 1]))
        last = (files[-1], blocks[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, (before, *depth, *after))],
            names=[*batch.schema.names, *[x.split()[0] for x in STATE.split(", ")]])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    plain = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)  # escaped characters are of no account

    def opened(parity: int) -> Column:
        text = F.array_join(F.filter("plain", lambda _, i: i % 2 == parity), "")
        return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), "value", plain.alias("plain"))
    return raw.select("file", "block", "nth", F.col("value").alias("piece"),
                      (F.size("plain") - 1).cast("long").alias("quotes"), opened(0).cast("long").alias("open0"),
                      opened(1).cast("long").alias("open1")).mapInArrow(_counted, f"{PIECES}, {STATE}")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: every outermost object of the files, whatever arrays, commas or line ends are around them.

    Values outside of objects are passed over, an object that is cut off at the end of its file is closed there.
    Behind a bracket too many in a file that is no JSON, the objects of that file are not found.
    """
    pieces = _pieces(spark, path)
    totals = pieces.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max_by("after0", "nth").alias("d0"), F.max_by("after1", "nth").alias("d1"))
    earlier = Window.partitionBy("file").orderBy("block")  # one row per range
    blocks = totals.withColumn("inside", (F.sum("quotes").over(earlier) - F.col("quotes")) % 2)
    own = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    blocks = blocks.withColumn("own", own).select(
        "file", "block", "inside", (F.sum("own").over(earlier) - F.col("own")).alias("deep"))
    case = F.col("inside") == 0
    depth = F.col("deep") + F.when(case, F.col("depth0")).otherwise(F.col("depth1"))
    after = F.col("deep") + F.when(case, F.col("after0")).otherwise(F.col("after1"))
    placed = pieces.join(blocks, ["file", "block"]).select(
        "file", "block", "nth", "piece", "open0", depth.alias("depth"), after.alias("after"),
        ((F.col("before") + F.col("inside")) % 2 == 0).alias("outside"),
        ((F.col("before") + F.col("quotes") + F.col("inside")) % 2 == 0).alias("closes"))
    between = F.col("outside") & (F.col("depth") == 0)
    starts = between & (F.col("open0") > 0)
    placed = placed.where(~(between & (F.col("open0") == 0) & F.col("closes")))  # what follows the last object
    whole = starts & F.col("closes") & (F.col("after") == 0)
    trimmed = F.regexp_replace("piece", r"^[^{]*", "")
    single = placed.where(whole).select("file", F.concat(trimmed, F.lit("}")).alias("text"))

    rest = placed.where(~whole).select("file", "block", "nth", F.when(starts, trimmed).otherwise(F.col("piece")).alias(
        "piece"), starts.cast("long").alias("s"))
    sums = rest.groupBy("file", "block").agg(F.sum("s").alias("n")).select(
        "file", "block", (F.sum("n").over(earlier) - F.col("n")).alias("ahead"))
    within = Window.partitionBy("file", "block").orderBy("nth")
    numbered = rest.withColumn("in_block", F.sum("s").over(within)).join(sums, ["file", "block"]).withColumn(
        "number", F.col("ahead") + F.col("in_block")).where("number > 0")
    parts = F.array_sort(F.collect_list(F.struct("block", "nth", "piece")))
    joined = numbered.groupBy("file", "number").agg(parts.alias("p")).select(
        "file", F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), "}"), F.lit("}")).alias("text"))
    return single.unionByName(joined)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of the files as rows of ``schema``; an object that does not fit gives a row of nulls."""
    return objects(spark, path).select(F.from_json("text", schema).alias("v")).select("v.*")
