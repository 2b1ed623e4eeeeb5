"""Helpers of the training-data operators: tables, columns, written intermediates, registration."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundalike.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space everywhere in this subpackage: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read of the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that goes to Python and back; texts are long, and Spark's default counts rows only.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
                "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded in bytes, too.

    Only settings that still have Spark's default are changed; results do not depend on them.
    """
    conf = df.sparkSession.conf
    for key, (default, value) in BATCH_BOUNDS.items():
        now = conf.get(key, None)
        if now is None or now == default or default is None and int(now) > 1 << 28:
            conf.set(key, value)
    return df


def hash_blocks(df: DataFrame, keys: Sequence[str], width: Column, most: int) -> int:
    """A number of hash blocks of different ``keys``, none of which has over ``most`` bytes beyond one row of it.

    Rows of a block are those of equal ``pmod(xxhash64(*keys), number)``.
    """
    total, widest = df.agg(F.sum(width), F.max(width)).first()
    n = max(1, -(-int(total or 0) // most))
    while n > 1:
        part = F.pmod(F.xxhash64(*keys), F.lit(n))
        if df.groupBy(part.alias("p")).agg(F.sum(width).alias("b")).agg(F.max("b")).first()[0] <= most + widest:
            break
        n *= 2
    return n


def private(name: str) -> str:
    """A column name that no input table carries; the same in every run, so plans can be compared."""
    return f"__soundalike_{name}"


def text_of(column: str | Column) -> Column:
    """The text, null counted as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def per_process(key: str, make: Callable[[], object]):
    """A value made once per Python process; task functions are shipped by value and would forget it."""
    name = "soundalike_process_cache"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
