"""Feature statistics, pooling, coverage and counters (inventory C6, C7, C10, E1, E11, E12, J8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundalike.functions.layout import HANDCRAFTED_DIM
from soundalike.functions.vectors import zscore

STD_FLOOR = 1e-10


def _floored(std: F.Column, mode: str) -> F.Column:
    if mode == "greatest":
        return F.greatest(std, F.lit(STD_FLOOR))
    if mode == "one":
        return F.when(std > STD_FLOOR, std).otherwise(F.lit(1.0))
    if mode == "zero":
        return F.when(std == 0, F.lit(1.0)).otherwise(std)
    raise ValueError(f"unknown floor mode {mode}")


def fit_stats(songs: DataFrame, vec: str = "handcrafted_raw", dim: int = HANDCRAFTED_DIM,
              floor_mode: str = "greatest") -> DataFrame:
    """One row ``mean, std, dim, n_songs`` with population deviations.

    Vectors of another length than ``dim`` take no part, in any position; :func:`rejected_widths`
    counts them.  One way for all widths: (position, value) rows, summed map-side.
    """
    per = (songs.where(F.size(vec) == dim).select(F.posexplode(vec).alias("i", "x"))
           .groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")))
    packed = per.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s", "n"))).alias("e"))  # dim rows
    return packed.select(
        F.col("e.m").alias("mean"),
        F.transform("e.s", lambda s: _floored(s, floor_mode)).alias("std"),
        F.lit(dim).alias("dim"), F.coalesce(F.array_max("e.n"), F.lit(0)).alias("n_songs"))


def rejected_widths(songs: DataFrame, vec: str = "handcrafted_raw", dim: int = HANDCRAFTED_DIM) -> DataFrame:
    """Rows per length of the vectors that :func:`fit_stats` leaves out."""
    return (songs.where(F.col(vec).isNotNull() & (F.size(vec) != dim))
            .groupBy(F.size(vec).alias("width")).agg(F.count("*").alias("count")))


def normalised(songs: DataFrame, stats: DataFrame, vec: str = "handcrafted_raw",
               out: str = "handcrafted_norm") -> DataFrame:
    """Z-scores of ``vec`` from one row of statistics (a scalar subquery)."""
    fitted = songs.withColumn("_mean", stats.select("mean").scalar()).withColumn(
        "_std", stats.select("std").scalar())
    return fitted.withColumn(out, zscore(vec, "_mean", "_std")).drop("_mean", "_std")


def renormalise(songs: DataFrame, vec: str = "handcrafted_raw", out: str = "handcrafted_norm",
                dim: int = HANDCRAFTED_DIM) -> DataFrame:
    """Fit the statistics and rewrite every row that has a raw vector."""
    return normalised(songs, fit_stats(songs, vec, dim), vec, out)


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str, out: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each key (e.g. frames of a track)."""
    per = (df.select(*keys, F.posexplode(vec).alias("_i", "_x"))
           .groupBy(*keys, "_i").agg(F.avg("_x").alias("_x")))
    return (per.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_e"))
            .select(*keys, F.col("_e._x").alias(out)))


def coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and non-null rows of every nullable column."""
    names = list(columns) if columns else [f.name for f in df.schema.fields if f.nullable]
    return df.agg(F.count("*").alias("rows"), *[F.count(n).alias(n) for n in names])


def outcome_counts(df: DataFrame, by: str = "outcome") -> DataFrame:
    """E12."""
    return df.groupBy(by).agg(F.count("*").alias("count"))
