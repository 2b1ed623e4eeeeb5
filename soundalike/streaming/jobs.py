"""Streaming jobs over votes, clicks, job events and new songs (inventory K1-K9).

Sinks write one folder per micro-batch and overwrite it on a replay, so a batch
that runs twice after a failure leaves the same files.  Changing results (update
mode) are versions of a row; :func:`current` reads the newest one per key.
"""

from __future__ import annotations

import datetime
import functools
import logging
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from soundalike.functions.text import pseudonym
from soundalike.operators import feedback as FB
from soundalike.operators import rules as RU
from soundalike.operators.catalog import feed
from soundalike.operators.jobs import SILENT_SECONDS, job_state
from soundalike.operators.search import nearest_for_new
from soundalike.session import cut

WEIGHT_TTL_SEC = 300
LOG = logging.getLogger(__name__)


# ------------------------------------------------------------------------- sources

def read_table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None
                      ) -> DataFrame:
    """A parquet folder (or glob) as a stream, with the schema of its present files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# --------------------------------------------------------------------------- sinks

def _start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
           mode: str = "append", **trigger) -> StreamingQuery:
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start())


#: Micro-batches between two snapshots of a sink that folds its versions.
FOLD_EVERY = 20
SNAPSHOT = "upto"
#: Written last by Spark's committer: a folder without it is not finished and is not read.
MARKER = "_SUCCESS"


def write_versions(df: DataFrame, path: str, checkpoint: str, mode: str = "update",
                   keys: Sequence[str] | None = None, fold_every: int = FOLD_EVERY, **trigger) -> StreamingQuery:
    """Every micro-batch to its own folder ``batch_id=n``.

    With ``keys`` every ``fold_every`` micro-batches are folded into a snapshot (:func:`compact`), so readers of
    :func:`current` never open more than one snapshot and ``fold_every`` folders, however long the stream runs.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if keys and (batch_id + 1) % fold_every == 0:
            compact(batch.sparkSession, path, keys, batch_id)
    return _start(df, each, checkpoint, mode, **trigger)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=n`` below ``path``, read through Spark's file system."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))


def _finished(spark: SparkSession, folder: str) -> bool:
    at, fs = _files(spark, f"{folder}/{MARKER}")
    return fs.exists(at)


def parts_of(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, list[int]]:
    """What :func:`current` reads: the newest finished snapshot and the finished micro-batches after it.

    With ``before`` only what was written by micro-batches of lower numbers, as a replayed batch has to see it.
    """
    def earlier(n: int) -> bool:
        return before is None or n < before
    snapshots = (n for n in reversed(_folders(spark, f"{path}_snapshots", SNAPSHOT)) if earlier(n))
    upto = next((n for n in snapshots if _finished(spark, f"{path}_snapshots/{SNAPSHOT}={n}")), None)
    tail = [n for n in _folders(spark, path, "batch_id") if earlier(n) and (upto is None or n > upto)]
    return upto, [n for n in tail if _finished(spark, f"{path}/batch_id={n}")]


def _versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    upto, tail = parts_of(spark, path, before)
    found = []
    if upto is not None:
        found.append(spark.read.parquet(f"{path}_snapshots/{SNAPSHOT}={upto}").withColumn(
            "batch_id", F.lit(upto).cast("long")))
    if tail:
        found.append(spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={n}" for n in tail]).withColumn(
            "batch_id", F.col("batch_id").cast("long")))
    return functools.reduce(DataFrame.unionByName, found) if found else None


def current(spark: SparkSession, path: str, keys: Sequence[str], before: int | None = None) -> DataFrame | None:
    """Newest version of every key written by :func:`write_versions`; None if nothing has been written.

    Reads the newest snapshot of :func:`compact`, if there is one, and the micro-batches after it.
    """
    versions = _versions(spark, path, before)
    if versions is None:
        return None
    rest = [c for c in versions.columns if c not in (*keys, "batch_id")]
    return (versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v"))
            .select(*keys, "v.*"))


def compact(spark: SparkSession, path: str, keys: Sequence[str], upto: int | None = None) -> None:
    """Fold the finished micro-batches (those up to ``upto``) into a snapshot, which :func:`current` then starts from.

    The snapshot is a new folder named by the last micro-batch in it and counts once its marker is there, so
    readers see the former state or the new one; nothing that is being read is touched.  A snapshot that is there
    already stays, so a replay changes nothing.  Folders up to that number may be removed at any later time.
    """
    done = [n for n in _folders(spark, path, "batch_id") if upto is None or n <= upto]
    if not done:
        return
    folder = f"{path}_snapshots/{SNAPSHOT}={done[-1]}"
    if not _finished(spark, folder):
        state = current(spark, path, keys, done[-1] + 1)
        if state is not None:
            state.write.mode("overwrite").parquet(folder)


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """The newest micro-batch alone: in complete mode it is the whole result."""
    return spark.read.parquet(f"{path}/batch_id={_folders(spark, path, 'batch_id')[-1]}")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a watermark has dropped, over the progress reports that are kept."""
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for report in query.recentProgress for op in report.get("stateOperators", []))


# ------------------------------------------------------------- K1, K2: event intake

def feedback_events(raw: DataFrame) -> DataFrame:
    """K1: votes with the address replaced by its pseudonym."""
    out = raw.withColumn("ip_hash", pseudonym("ip")).drop("ip")
    return out if "reason_tag" in out.columns else out.withColumn(
        "reason_tag", F.lit(None).cast("string"))


def ingest_events(stream: DataFrame, rules: RU.Rules, good_path: str, bad_path: str,
                  checkpoint: str, **trigger) -> StreamingQuery:
    """K1/K2: valid events to one table, the others with their reasons to another.

    A bad event never stops the stream.
    """
    marked = RU.with_reasons(stream, rules)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good = batch.where(F.size("reasons") == 0).drop("reasons")
        good.write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
        batch.where(F.size("reasons") > 0).write.mode("overwrite").parquet(
            f"{bad_path}/batch_id={batch_id}")
        batch.unpersist()

    return _start(marked, each, checkpoint, **trigger)


# ----------------------------------------------------------- K3: vote aggregates

def stream_feedback_stats(votes: DataFrame) -> DataFrame:
    """K3: the pair counters of E2; additive, so they run in update mode."""
    return FB.feedback_stats(votes)


def stream_focus_votes(votes: DataFrame, songs: DataFrame) -> DataFrame:
    """K3: positive votes per genre and focus (stream-static join), the counts behind E4."""
    genres = songs.where(F.col("genre").isNotNull()).select(
        F.col("id").alias("query_song_id"), "genre")
    return (votes.where(F.col("focus_active").isNotNull() & (F.col("rating") == 1))
            .join(genres, "query_song_id")
            .groupBy("genre", "focus_active").agg(F.count("*").alias("vote_count")))


# --------------------------------------------------------------- K4, K5: job state

def stream_job_state(events: DataFrame) -> DataFrame:
    """K4: the newest state of every job, in update mode."""
    return job_state(events)


#: An absent time or number; it is before every other, as in :func:`job_state`.
NOTHING = -(1 << 62)
#: Due time of a job whose silence cannot be measured.
NEVER = 1 << 62
STALL_OUT = "job_id string, status string, updated_at timestamp, stalled boolean"
STALL_STATE = "job array<string>, at array<long>, seq array<long>, due array<long>"
#: Groups that :func:`stream_stalled_jobs` keeps its jobs in.
JOB_GROUPS = 1 << 14


def _newest_events(pdf: pd.DataFrame) -> Iterator[tuple]:
    """``job, status, time, seq`` of the newest event of every job; of equal ones the last."""
    def or_none(x):
        return None if pd.isna(x) else x
    absent = pdf["updated_at"].isna().to_numpy()
    times = pd.to_datetime(pdf["updated_at"]).to_numpy("datetime64[us]").astype("i8")
    times[absent] = NOTHING
    if "seq" not in pdf:
        seqs = np.zeros(len(pdf), "i8")
    elif pdf["seq"].dtype.kind in "iu":
        seqs = pdf["seq"].to_numpy("i8")
    else:
        seqs = np.array([NOTHING if pd.isna(x) else int(x) for x in pdf["seq"]], "i8")
    codes, jobs = pd.factorize(pdf["job_id"], use_na_sentinel=False)
    order = np.lexsort((seqs, times, codes))
    newest = order[np.append(codes[order][1:] != codes[order][:-1], True)]
    for job, status, at, seq in zip(jobs, pdf["status"].to_numpy()[newest], times[newest].tolist(), seqs[newest].tolist()):
        yield or_none(job), or_none(status), at, seq


def stream_stalled_jobs(events: DataFrame, after_sec: int = SILENT_SECONDS,
                        clock: str = "processing", watermark: str | None = None,
                        groups: int = JOB_GROUPS) -> DataFrame:
    """K5: status changes, plus a ``stalled`` report once a job has been silent too long.

    State per job that is being processed is its last time.  A later real update is reported as
    it comes and so replaces the stall.  ``clock="event"`` measures silence on event
    time behind ``watermark`` instead of the wall clock; the caller says how late events
    may be, and :func:`late_rows` counts what came later.  Events of one instant are
    ordered by ``seq`` where there is one, across micro-batches too; an event without a time
    or ``seq`` is before every event that has one.  The wall clock needs a
    running query (``processingTime`` trigger): it always has one more batch to run,
    so ``availableNow`` would not end.

    Jobs share the state of one of ``groups`` hash groups, so that a call of Python answers many of them; every
    job has its own due time in it, and the group wakes up at the first.  ``groups`` stays fixed over a checkpoint.
    """
    on_event = clock == "event"
    if on_event and watermark is None:
        raise ValueError("event time needs a watermark: how late may events be?")
    source = events.withWatermark("updated_at", watermark) if on_event else events
    job = F.col("job_id").cast("string")
    source = source.select(job.alias("job_id"), "status", "updated_at", *[c for c in events.columns if c == "seq"],
                           F.pmod(F.xxhash64(job), F.lit(groups)).alias("_group"))
    wait_ms = after_sec * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() if on_event else state.getCurrentProcessingTimeMs()
        waiting = {j: rest for j, *rest in zip(*state.get)} if state.exists else {}
        last = {}
        for pdf in () if state.hasTimedOut else batches:
            for job, status, at, seq in _newest_events(pdf):
                if job not in last and job in waiting:
                    last[job] = ("processing", *waiting[job][:2])
                if job not in last or (at, seq) >= last[job][1:]:
                    last[job] = (status, at, seq)
        out = [(str(job), status, at, False) for job, (status, at, _) in last.items()]
        for job in [j for j, (_, _, due) in waiting.items() if j not in last and due < now]:
            out.append((str(job), "failed", waiting.pop(job)[0], True))
        for job, (status, at, seq) in last.items():
            if status != "processing":
                waiting.pop(job, None)
            elif at == NOTHING:  # without a time there is no silence to measure
                waiting[job] = [at, seq, NEVER]
            else:
                waiting[job] = [at, seq, max(at // 1000 + wait_ms, now + 1) if on_event else now + wait_ms]
        if waiting:
            state.update(([*waiting], *map(list, zip(*waiting.values()))))
            due = min(due for _, _, due in waiting.values())
            if due < NEVER and on_event:
                state.setTimeoutTimestamp(max(due, now + 1))
            elif due < NEVER:
                state.setTimeoutDuration(max(due - now, 1))
        elif state.exists:
            state.remove()
        if out:
            jobs, statuses, times, stalled = zip(*out)
            times = np.array([np.iinfo("i8").min if t == NOTHING else t for t in times], "datetime64[us]")
            yield pd.DataFrame({"job_id": jobs, "status": pd.Series(statuses, dtype=object),
                                "updated_at": times.astype("datetime64[ns]"), "stalled": stalled})

    timeout = (GroupStateTimeout.EventTimeTimeout if on_event
               else GroupStateTimeout.ProcessingTimeTimeout)
    return source.groupBy("_group").applyInPandasWithState(step, STALL_OUT, STALL_STATE, "update", timeout)


# ------------------------------------------------------- K6, K7: serving side inputs

class Refreshed:
    """K6: a side input that is re-read at most every ``ttl_sec`` seconds.

    The value is materialised on reading, so a source that fails does so here: the
    previous value stays and the source is not tried again before the next interval.
    ``failures`` counts such readings and ``error`` is the last one; each is logged.  Used inside ``foreachBatch``, i.e. on the driver.
    """

    def __init__(self, load: Callable[[], DataFrame], ttl_sec: float = WEIGHT_TTL_SEC,
                 clock: Callable[[], float] = time.monotonic):
        self._load, self._ttl, self._clock = load, ttl_sec, clock
        self._at: float | None = None
        self._value: DataFrame | None = None
        self.failures = 0
        self.error: Exception | None = None

    def get(self) -> DataFrame | None:
        now = self._clock()
        if self._at is None or now - self._at > self._ttl:
            self._at = now
            try:
                self._value = cut(self._load())
            except Exception as error:  # noqa: BLE001 - any source error keeps the old value
                self.failures, self.error = self.failures + 1, error
                LOG.warning("side input not read, the former value stays: %s", error)
        return self._value


def stream_recommend(new_songs: DataFrame, catalogue: Refreshed, path: str, checkpoint: str,
                     k: int = 20, **trigger) -> StreamingQuery:
    """K7: the k nearest catalogue songs of every song that arrives.

    Without a catalogue the micro-batch fails and is tried again; it is never passed over.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        songs = catalogue.get()
        if songs is None:
            raise RuntimeError("no catalogue could be read yet")
        batch.persist()
        nearest_for_new(batch, songs, k).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()
    return _start(new_songs, each, checkpoint, **trigger)


def stream_beside(stream: DataFrame, side: Refreshed, join: Callable[[DataFrame, DataFrame], DataFrame],
                  path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """K6: every micro-batch joined with the side input as it is at that time."""
    def each(batch: DataFrame, batch_id: int) -> None:
        value = side.get()
        if value is None:
            raise RuntimeError("the side input could not be read yet")
        join(batch, value).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return _start(stream, each, checkpoint, **trigger)


# ------------------------------------------------------------------- J10: work feed

def stream_feed(work: DataFrame, existing: DataFrame, path: str, ledger: str, checkpoint: str,
                key: str = "deezer_id", fold_every: int = FOLD_EVERY, **trigger) -> StreamingQuery:
    """Outcomes of a work list as it grows, and a ledger of what has been dealt with.

    An item of an earlier micro-batch is ``processed``.  The ledger is written after the outcomes, a folder per
    micro-batch, and folded like the versions of :func:`write_versions`; :func:`current` reads it.  A replayed
    batch reads what came before it only, so it comes out the same.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _versions(spark, ledger, batch_id)
        done = None if earlier is None else earlier.select(key)
        batch.persist()
        out = feed(batch, existing, done, key=key)
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        out.where(F.col("outcome") != "processed").select(key, "outcome").distinct().write.mode(
            "overwrite").parquet(f"{ledger}/batch_id={batch_id}")
        batch.unpersist()
        if (batch_id + 1) % fold_every == 0:
            compact(spark, ledger, [key], batch_id)
    return _start(work, each, checkpoint, **trigger)


# ------------------------------------------------------------- K8, K9: event rates

def stream_windowed_counts(stream: DataFrame, keys: Sequence[str | Column], watermark: str,
                           window: str = "1 hour", ts: str = "created_at") -> DataFrame:
    """K8: events per key and tumbling window.

    ``watermark`` says how late events may be; :func:`late_rows` counts what came later.
    """
    return (stream.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"), *keys)
            .agg(F.count("*").alias("events"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *keys, "events"))


AB_KEYS = ("window_start", "ab_group", "action", "session_hash")


def stream_ab_sessions(stream: DataFrame, watermark: str, window: str = "1 day",
                       ts: str = "created_at") -> DataFrame:
    """K9: events of every session per tumbling window, group and action; see :func:`ab_windows`."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), "ab_group", "action", "session_hash")
            .agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))
            .select(F.col("w.start").alias("window_start"), "ab_group", "action", "session_hash", "events",
                    "first", "last"))


def ab_windows(sessions: DataFrame) -> DataFrame:
    """K9: E6 per window from the current rows of :func:`stream_ab_sessions`; sessions are counted exactly."""
    return sessions.groupBy("window_start", "ab_group", "action").agg(
        F.sum("events").alias("event_count"), F.count("*").alias("unique_sessions"),
        F.to_date(F.min("first")).alias("first_event"), F.to_date(F.max("last")).alias("last_event"))


#: Time of the mark that ends a stream of events for good.
FOREVER = datetime.datetime(9999, 1, 1)


def end_marks(spark: SparkSession, path: str, ts: str = "created_at") -> DataFrame:
    """The marks of :func:`mark_end` as a stream; there may be none yet, the folder is made."""
    at, fs = _files(spark, path)
    fs.mkdirs(at)
    return spark.readStream.schema(f"{ts} timestamp").parquet(path)


def mark_end(spark: SparkSession, path: str, at: datetime.datetime = FOREVER, ts: str = "created_at") -> None:
    """Say that all events before ``at`` have been sent: visits that ended by then (less the lateness) are closed."""
    spark.createDataFrame([(at,)], f"{ts} timestamp").coalesce(1).write.mode("append").parquet(path)


def stream_sessions(stream: DataFrame, watermark: str, gap: str = "30 minutes",
                    ts: str = "created_at", ends: DataFrame | None = None) -> DataFrame:
    """K9: visits of a session hash, closed after ``gap`` without an event.

    A later event can change the start of a visit, so versions by start would leave stale visits.  In append
    mode a visit comes out once, when it is closed, and leaves the state; ``ends``, a stream of :func:`end_marks`,
    closes those that are still open when the events stop.  In complete mode :func:`last_batch` is the whole result.
    """
    rows = stream.select(ts, "session_hash", F.lit(False).alias("_end"))
    if ends is not None:
        rows = rows.unionByName(ends.select(ts, F.lit(None).cast("string").alias("session_hash"),
                                            F.lit(True).alias("_end")))
    return (rows.withWatermark(ts, watermark)
            .groupBy(F.session_window(ts, gap).alias("w"), "session_hash", "_end")
            # A condition on ``_end`` itself would be pushed below the watermark, which then never sees the marks.
            .agg(F.count_if(~F.col("_end")).alias("events")).where("events > 0")
            .select("session_hash", F.col("w.start").alias("started"),
                    F.col("w.end").alias("ended"), "events"))
