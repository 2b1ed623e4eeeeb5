"""Sinks (inventory A10-A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_songs(new_songs: DataFrame, path: str) -> None:
    """A10: append rows that an import has already reduced to new ones."""
    new_songs.write.mode("append").parquet(path)


def write_features(df: DataFrame, path: str, vectors: tuple[str, ...] = ("learned", "handcrafted_raw")
                   ) -> None:
    """One JSON object per line, vectors as JSON text, appended."""
    names = {"learned": "learned_embedding"}
    out = df
    for v in vectors:
        out = out.withColumn(names.get(v, v), F.to_json(v))
        if v in names:
            out = out.drop(v)
    out.write.mode("append").json(path)


def write_stats(stats: DataFrame, path: str, key: str = "normalization_stats") -> None:
    """Append a version; readers take the latest."""
    stats.withColumn("key", F.lit(key)).withColumn("updated_at", F.current_timestamp()).write.mode(
        "append").parquet(path)


def latest_stats(versions: DataFrame, key: str = "normalization_stats") -> DataFrame:
    """The newest version of a key."""
    fields = [c for c in versions.columns if c not in ("key", "updated_at")]
    return (versions.where(F.col("key") == key)
            .agg(F.max_by(F.struct(*fields), "updated_at").alias("v")).select("v.*"))
