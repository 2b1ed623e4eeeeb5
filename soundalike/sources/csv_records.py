"""Records of quoted CSV files that may be of any size and differ in their headers (inventory A2, A4, A5).

Spark reads a file whose values contain line ends in one task.  Here files are read as lines, in byte ranges.  A
line begins a record if the quotes before it in its file are even in number: lines are counted within their range,
ranges by a running sum over one narrow row each.  Records of one line, nearly all, stay where they were read;
only lines of longer ones are shuffled and put together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundalike.session import cut


LINES = "file string, block long, nth long, line string, quotes long, before long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each line and those before it in its range; a task reads a range in order."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        quotes = pc.count_substring(batch.column("line"), '"').cast(pa.int64()).to_numpy()
        place = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        upto = np.cumsum(quotes)
        turns = [i for i in range(len(place)) if place[i] != (place[i - 1] if i else last)]
        before = upto - quotes + total
        for i in turns:
            before[i:] -= before[i]
        last, total = place[-1], int(before[-1] + quotes[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quotes), pa.array(before)],
                                         names=[*batch.schema.names, "quotes", "before"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    return raw.mapInArrow(_counted, LINES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, record``: whole records; ``at`` orders those of a file, its header is the first."""
    lines = _lines(spark, path)
    earlier = Window.partitionBy("file").orderBy("block")
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes")).select(
        "file", "block", (F.sum("quotes").over(earlier) - F.col("quotes")).alias("ahead"))
    placed = lines.join(blocks, ["file", "block"]).withColumn("starts", (F.col("before") + F.col("ahead")) % 2 == 0)
    whole = F.col("starts") & (F.col("quotes") % 2 == 0)
    single = placed.where(whole).select("file", F.struct("block", "nth").alias("at"), F.col("line").alias("record"))

    # The number of starts up to a line names its record; the running sum is again taken over ranges first.
    rest = placed.where(~whole).select("file", "block", "nth", "line", F.col("starts").cast("long").alias("s"))
    sums = rest.groupBy("file", "block").agg(F.sum("s").alias("n")).select(
        "file", "block", (F.sum("n").over(earlier) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("file", "block").orderBy("nth")
    numbered = rest.withColumn("in_block", F.sum("s").over(inside)).join(sums, ["file", "block"]).withColumn(
        "number", F.col("ahead") + F.col("in_block"))
    parts = F.array_sort(F.collect_list(F.struct("block", "nth", "line")))
    first = F.get("p", F.lit(0))
    joined = numbered.groupBy("file", "number").agg(parts.alias("p")).select(
        "file", F.struct(first["block"].alias("block"), first["nth"].alias("nth")).alias("at"),
        F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("record"))
    every = single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return every.where(F.trim("record") != "")


def _cells(record: Column, width: int) -> Column:
    """The values of a record; absent ones are null."""
    shape = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    parsed = F.from_csv(record, shape.simpleString()[len("struct<"):-1].replace(":", " "), {
        "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def read(spark: SparkSession, path: str, header_rows: int = 1, need: Sequence[str] = (),
         shared: bool = False) -> DataFrame:
    """``file, cells, headers``: the rows of all files, each with the header rows of its own file.

    Columns may stand in another order in every file.  A file without one of the names in ``need`` in its headers
    raises a ``ValueError`` that names it; with ``shared``, such a file is the continuation of another one, if
    there is only one header to choose.
    """
    every = records(spark, path)
    first = Window.partitionBy("file").orderBy("at")
    top = cut(every.withColumn("n", F.row_number().over(first)).where(F.col("n") <= header_rows).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("at", "record"))).alias("top")))  # header_rows per file
    commas = F.transform("top", lambda t: F.length(t["record"]) - F.length(F.replace(t["record"], F.lit(","), F.lit(""))))
    width = top.agg(F.max(F.array_max(commas))).first()[0]
    width = (width or 0) + 1
    plain = lambda t: F.replace(t["record"], F.lit("\ufeff"), F.lit(""))
    heads = top.select("file", F.array(*[_cells(plain(F.get("top", F.lit(i))), width) for i in range(header_rows)]).alias(
        "headers"), F.get("top", F.lit(header_rows - 1))["at"].alias("last"))
    named = F.flatten(F.transform("headers", lambda h: F.transform(h, lambda c: F.coalesce(F.trim(c), F.lit("")))))
    has = {name: F.array_contains(named, name) for name in need}
    complete = functools.reduce(lambda a, b: a & b, has.values(), F.lit(True))
    if shared and not heads.where(~complete).isEmpty():
        only = heads.where(complete).select("headers").distinct().limit(2).collect()
        if len(only) == 1:
            known = F.array(*[F.array(*[F.lit(c) for c in row]) for row in only[0].headers])
            none = F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("nth"))
            heads = heads.select("file", F.when(complete, F.col("headers")).otherwise(known).alias("headers"),
                                 F.when(complete, F.col("last")).otherwise(none).alias("last"))
    for name, here in has.items():
        lacking = heads.where(~here).select("file").first()
        if lacking:
            raise ValueError(f"{lacking.file} has no column {name}")
    rows = every.join(heads, "file").where(F.col("at") > F.col("last"))
    return rows.select("file", _cells(F.col("record"), width).alias("cells"), "headers")


def value(name: str, row: int = 0) -> Column:
    """The cell below ``name`` in a header row; null where the file has no such column."""
    names = F.transform(F.get("headers", F.lit(row)), lambda c: F.coalesce(F.trim(c), F.lit("")))
    return F.get("cells", F.array_position(names, name).cast("int") - 1)
