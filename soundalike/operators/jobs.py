"""Analysis jobs and the upload folder (inventory G7, J14, K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.session import cut

# A job is silent too long after 300 s, a file without a job goes after a day, a folder holds 5 GiB.
SILENT_SECONDS = 300
LEFTOVER_SECONDS = 86_400
FOLDER_BYTES = 5 << 30
SILENT_NOTE = "no update within the time allowed"
TERMINAL = ("completed", "failed")
FIELDS = ("progress", "audio_path", "duration_sec", "result", "last_error")


def job_state(events: DataFrame, order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """Current state per job from its status events.

    A field keeps its last non-null value; ``completed_at`` is the time of the last
    terminal event.  Plain aggregates, so events combine map-side.
    """
    at = F.struct(*order)
    fields = [f for f in FIELDS if f in events.columns]
    terminal = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields],
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.max(F.when(terminal, F.col("updated_at"))).alias("completed_at"))


def _age(now: Column, since: str) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(since).cast("timestamp"))


def stalled_jobs(state: DataFrame, now: Column, after_sec: int = SILENT_SECONDS) -> DataFrame:
    """K5, batch: jobs ``processing`` without an update for longer than ``after_sec``.

    Reported as failed; the ledger is left alone, so a later update wins.
    """
    stale = (F.col("status") == "processing") & (_age(now, "updated_at") > after_sec * 1_000_000)
    stale = F.coalesce(stale, F.lit(False))
    out = state.withColumn("_stale", stale)
    return (out.withColumn("status", F.when(F.col("_stale"), "failed").otherwise(F.col("status")))
            .withColumn("error", F.when(F.col("_stale"), SILENT_NOTE).otherwise(F.col("last_error")))
            .withColumnRenamed("_stale", "stalled"))


def retention_plan(files: DataFrame, jobs: DataFrame, now: Column,
                   max_age_sec: int = LEFTOVER_SECONDS, cap_bytes: int = FOLDER_BYTES,
                   slices: int | None = None) -> DataFrame:
    """Every file with ``action`` keep / finished / orphan / over_cap.

    ``files``: ``stem, size, modified``; ``jobs``: ``job_id, status``.  After
    finished and orphaned files are gone, the oldest files without an active job go
    until the rest fits ``cap_bytes``.  The running total over all files is taken in
    range partitions of (time, name): totals per slice first, then within each slice.
    """
    state = jobs.select(F.col("job_id").cast("string").alias("stem"),
                        F.col("status").isin(*TERMINAL).alias("_done"))
    rows = files.join(state, "stem", "left")
    active = F.col("_done").isNotNull() & ~F.coalesce("_done", F.lit(True))
    orphan = F.col("_done").isNull() & (_age(now, "modified") > max_age_sec * 1_000_000)
    rows = rows.withColumn("_active", active).withColumn(
        "_first", F.when(F.coalesce("_done", F.lit(False)), "finished").when(orphan, "orphan"))

    left = rows.where(F.col("_first").isNull())
    total = left.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).select("t").scalar()
    idle = left.where(~F.col("_active"))
    # The name splits files of equal time; the checkpoint fixes the sampled ranges.
    by = ("modified", "stem")
    idle = idle.repartitionByRange(slices, *by) if slices else idle.repartitionByRange(*by)
    idle = cut(idle.withColumn("_slice", F.spark_partition_id()))
    per_slice = idle.groupBy("_slice").agg(F.sum("size").alias("_sum"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_slice").orderBy("modified", "stem").rowsBetween(
        Window.unboundedPreceding, -1)
    idle = (idle.join(base, "_slice").withColumn(
        "_gone", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("action", F.when(total - F.col("_gone") > cap_bytes, "over_cap")
                    .otherwise("keep")))
    out = files.columns
    return (rows.where(F.col("_first").isNotNull()).select(*out, F.col("_first").alias("action"))
            .unionByName(left.where(F.col("_active")).select(*out, F.lit("keep").alias("action")))
            .unionByName(idle.select(*out, "action")))
