"""Source readers (inventory A1-A9, A13).  Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundalike import schemas
from soundalike.functions.text import nonempty, strip
from soundalike.functions.vectors import parse_vector, valid_vector
from soundalike.sources import csv_records, json_records

TAG_PREFIX = "genre---"
RAW_TRACK_FIELDS = ("track_title", "artist_name", "album_title", "track_duration",
                    "track_genres", "track_date_recorded", "track_date_created")


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """A1: parsed lines plus ``_corrupt`` with the text of malformed ones; blanks are skipped."""
    return (spark.read.schema(schemas.FEATURE_LINE).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def read_features_jsonl(spark: SparkSession, path: str, *, learned_dim: int = 200,
                        handcrafted_dim: int = 44) -> tuple[DataFrame, DataFrame]:
    """(rows with typed vectors, quarantined rows with ``reason``).

    A line is quarantined when it is not JSON or a vector has the wrong length.
    """
    lines = feature_lines(spark, path)
    typed = (lines.withColumn("deezer_id", F.col("_tid").try_cast("long"))
             .withColumn("learned", parse_vector("learned_embedding"))
             .withColumn("handcrafted_raw", parse_vector("handcrafted_raw"))
             .withColumn("handcrafted_norm", parse_vector("handcrafted_norm"))
             .drop("_tid", "learned_embedding"))

    def fits(c: str, n: int, optional: bool = False) -> Column:
        ok = valid_vector(c, n)
        return F.col(c).isNull() | ok if optional else ok

    reason = (F.when(F.col("_corrupt").isNotNull(), "malformed")
              .when(~fits("learned", learned_dim), "learned_dim")
              .when(~fits("handcrafted_raw", handcrafted_dim), "handcrafted_dim")
              .when(~fits("handcrafted_norm", handcrafted_dim, True), "handcrafted_dim"))
    typed = typed.withColumn("reason", reason)
    good = typed.where(F.col("reason").isNull()).drop("reason", "_corrupt")
    return good, typed.where(F.col("reason").isNotNull())


def read_fma_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A2: quoted, possibly multi-line CSV of any size; rows without an integer id are dropped.

    Columns are picked by name from the header of their own file, which must have ``track_id``; other absent
    columns are empty.
    """
    rows = csv_records.read(spark, path, need=("track_id",))
    text = [strip(F.coalesce(csv_records.value(f), F.lit(""))).alias(f) for f in RAW_TRACK_FIELDS]
    return rows.select(strip(csv_records.value("track_id")).try_cast("long").alias("track_id"), *text).where(
        F.col("track_id").isNotNull())


def dropped_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A2: rows that :func:`read_fma_tracks` leaves out, per file."""
    rows = csv_records.read(spark, path, need=("track_id",))
    bad = strip(csv_records.value("track_id")).try_cast("long").isNull()
    return rows.where(bad).groupBy("file").agg(F.count("*").alias("dropped"))


def read_fma_genres(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``genre_id, title, top_level``, by the header of each file; rows without an integer id are dropped."""
    rows = csv_records.read(spark, path, need=("genre_id", "title", "top_level"))
    number = {c: strip(csv_records.value(c)).try_cast("int").alias(c) for c in ("genre_id", "top_level")}
    return rows.select(number["genre_id"], csv_records.value("title").alias("title"), number["top_level"]).where(
        F.col("genre_id").isNotNull())


def read_fma_subset(spark: SparkSession, path: str, subset: str = "small") -> DataFrame:
    """A5: tracks of one subset that have a top genre, from files with a two-row header.

    The two header rows name (group, field) of each column.  A file may continue another one, whose header then
    counts for both; where no header has the columns, or files without one could continue several, it raises.
    """
    rows = csv_records.read(spark, path, header_rows=2, need=("set", "track", "subset", "genre_top"),
                            shared=True)

    def value(group: str, field: str) -> Column:
        both = F.arrays_zip(F.get("headers", F.lit(0)).alias("g"), F.get("headers", F.lit(1)).alias("f"))
        here = F.transform(both, lambda x: F.coalesce(F.concat_ws("|", F.trim(x["g"]), F.trim(x["f"])), F.lit("")))
        return F.get("cells", F.array_position(here, f"{group}|{field}").cast("int") - 1)

    return (rows.select(F.get("cells", F.lit(0)).try_cast("long").alias("track_id"), value("set", "subset").alias("subset"),
                        value("track", "genre_top").alias("genre_top"))
            .where(F.col("track_id").isNotNull() & (F.col("subset") == subset) & nonempty("genre_top").isNotNull())
            .select("track_id", "genre_top"))


def jamendo_tags(lines: DataFrame) -> DataFrame:
    """Ragged lines ``value`` -> ``track_id, path, tag_duration, tags``."""
    parts = F.split(strip("value"), "\t")
    tagged = F.filter(F.transform(F.slice(F.col("p"), 6, 1 << 20), strip),
                      lambda t: t.startswith(TAG_PREFIX))
    return (lines.select(parts.alias("p"))
            .where((F.size("p") >= 6) & (F.get("p", F.lit(0)) != "TRACK_ID"))
            .select(F.get("p", F.lit(0)).alias("track_id"), F.get("p", F.lit(3)).alias("path"),
                    F.coalesce(F.get("p", F.lit(4)).try_cast("double"), F.lit(0.0)).alias(
                        "tag_duration"),
                    F.transform(tagged, lambda t: F.substring(t, len(TAG_PREFIX) + 1, 1 << 20)
                                ).alias("tags")))


def jamendo_meta(lines: DataFrame) -> DataFrame:
    """Lines ``value`` -> ``track_id, title, artist, album, release_year``."""
    date = F.get("p", F.lit(6))
    year = F.when(date.contains("-"), F.get(F.split(date, "-"), F.lit(0)).try_cast("int"))
    return (lines.select(F.split(strip("value"), "\t").alias("p"))
            .where((F.size("p") >= 7) & (F.get("p", F.lit(0)) != "TRACK_ID"))
            .select(F.get("p", F.lit(0)).alias("track_id"), F.get("p", F.lit(3)).alias("title"),
                    F.get("p", F.lit(4)).alias("artist"), F.get("p", F.lit(5)).alias("album"),
                    year.alias("release_year")))


def read_jamendo_tags(spark: SparkSession, path: str) -> DataFrame:
    return jamendo_tags(spark.read.text(path))


def read_jamendo_meta(spark: SparkSession, path: str) -> DataFrame:
    return jamendo_meta(spark.read.text(path))


def read_track_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON arrays of crawled tracks: files of any size and layout, or one array per line with ``lines``."""
    if lines:
        return spark.read.schema(schemas.TRACK_LIST).json(path)
    return json_records.read(spark, path, schemas.TRACK_LIST)


def list_audio(spark: SparkSession, path: str, pattern: str = "*.mp3") -> DataFrame:
    """The files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(path)
            .select("path", "length", "modificationTime"))


def audio_inventory(files: DataFrame) -> DataFrame:
    """Files whose stem is an integer track id."""
    stem = F.regexp_extract("path", r"([^/]+)\.mp3$", 1)
    return files.withColumn("track_id", stem.try_cast("long")).where(
        F.col("track_id").isNotNull())


def conventional_path(track_id: Column) -> Column:
    """``2`` -> ``000/000002.mp3``."""
    padded = F.lpad(track_id.cast("string"), 6, "0")
    long_id = F.when(F.length(track_id.cast("string")) > 6, track_id.cast("string")).otherwise(padded)
    return F.concat(F.substring(long_id, 1, 3), F.lit("/"), long_id, F.lit(".mp3"))


def match_audio(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Each track's file: its own path, else the low-quality variant, else none.

    ``tracks``: ``path``; ``files``: ``rel_path`` (relative to the audio folder).
    """
    low = F.replace("path", F.lit(".mp3"), F.lit(".low.mp3"))
    have = files.select("rel_path").distinct()
    a = have.select(F.col("rel_path").alias("path"), F.col("rel_path").alias("_own"))
    b = have.select(F.col("rel_path").alias("_low_path"), F.col("rel_path").alias("_low"))
    return (tracks.withColumn("_low_path", low).join(a, "path", "left")
            .join(b, "_low_path", "left")
            .withColumn("audio_path", F.coalesce("_own", "_low"))
            .drop("_own", "_low", "_low_path"))


def read_stats(config: DataFrame) -> DataFrame:
    """Statistics from key/value rows (``key, value`` JSON); both known shapes are accepted."""
    shape = T.StructType([
        T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("mean", "means", "std", "stds")]
        + [T.StructField("dim", T.IntegerType()), T.StructField("n_songs", T.LongType())])
    known = config.where(F.col("key").isin("normalization_stats", "handcrafted_norm_stats"))
    return known.select("key", F.from_json("value", shape).alias("v")).select(
        "key", F.coalesce("v.mean", "v.means").alias("mean"),
        F.coalesce("v.std", "v.stds").alias("std"), "v.dim", "v.n_songs")
