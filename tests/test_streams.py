"""Streams: one and several micro-batches give the same rows as the batch twin."""

from datetime import datetime, timedelta

import pytest

from soundalike.operators import feedback as FB
from soundalike.operators import jobs as JB
from soundalike.operators import rules as RU
from soundalike.streaming import jobs as ST

T0 = datetime(2024, 1, 1)


def write_in_files(spark, rows, schema, folder, n):
    for i in range(n):
        part = spark.createDataFrame(rows[i::n] if n > 1 else rows, schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))


VOTES = [(i, i % 4, i % 3, 1 if i % 5 else -1, ["timbre", None][i % 2], f"10.0.0.{i % 3}",
          T0 + timedelta(minutes=i)) for i in range(60)]
VOTE_SCHEMA = ("id long, query_song_id long, result_song_id long, rating int, focus_active string, "
               "ip string, created_at timestamp")


def as_set(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("files", [1, 3])
def test_feedback_stats_stream(spark, tmp_path, files):
    write_in_files(spark, VOTES, VOTE_SCHEMA, tmp_path / "in", files)
    stream = ST.read_table_stream(spark, str(tmp_path / "in"), 1)
    out = str(tmp_path / "out")
    ST.write_versions(ST.stream_feedback_stats(stream), out, str(tmp_path / "cp")).awaitTermination()
    keys = ["query_song_id", "result_song_id"]
    assert as_set(ST.current(spark, out, keys)) == as_set(
        FB.feedback_stats(spark.createDataFrame(VOTES, VOTE_SCHEMA)))
    before = as_set(ST.current(spark, out, keys))
    ST.compact(spark, out, keys)
    assert as_set(ST.current(spark, out, keys)) == before and len(before) == 12
    spark.createDataFrame([(0, 0, 9, 9, 0, 18)], ST.current(spark, out, keys).schema).limit(1).write.parquet(
        f"{out}/batch_id=77")  # a later micro-batch replaces the row of the snapshot
    after = {(r.query_song_id, r.result_song_id): r for r in ST.current(spark, out, keys).collect()}
    assert len(after) == 12 and after[0, 0][2] == 9


@pytest.mark.parametrize("files", [1, 3])
def test_ingest_splits_and_hides_addresses(spark, tmp_path, files):
    rows = VOTES + [(99, None, 1, 1, None, "1.1.1.1", T0), (98, 1, 1, 7, None, "1.1.1.1", T0)]
    write_in_files(spark, rows, VOTE_SCHEMA, tmp_path / "in", files)
    stream = ST.feedback_events(ST.read_table_stream(spark, str(tmp_path / "in"), 1))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    ST.ingest_events(stream, RU.feedback_rules(), good, bad, str(tmp_path / "cp")).awaitTermination()
    g, b = spark.read.parquet(good), spark.read.parquet(bad)
    assert g.count() == 60 and "ip" not in g.columns
    assert {r.id: r.reasons for r in b.collect()} == {99: ["query_missing"], 98: ["bad_rating"]}
    assert all(len(r.ip_hash) == 16 for r in g.collect())


@pytest.mark.parametrize("files", [1, 3])
def test_job_state_stream(spark, tmp_path, files):
    rows = [(f"j{i % 5}", i, ["queued", "processing", "completed"][i % 3], i / 50, None, T0 + timedelta(seconds=i))
            for i in range(40)]
    schema = "job_id string, seq long, status string, progress double, last_error string, updated_at timestamp"
    write_in_files(spark, rows, schema, tmp_path / "in", files)
    out = str(tmp_path / "out")
    ST.write_versions(ST.stream_job_state(ST.read_table_stream(spark, str(tmp_path / "in"), 1)), out,
                      str(tmp_path / "cp")).awaitTermination()
    assert as_set(ST.current(spark, out, ["job_id"])) == as_set(
        JB.job_state(spark.createDataFrame(rows, schema)))


def test_stalled_stream_and_late_update(spark, tmp_path):
    schema = "job_id string, status string, updated_at timestamp"
    out, cp, src = str(tmp_path / "out"), str(tmp_path / "cp"), tmp_path / "in"

    def run():
        stream = ST.read_table_stream(spark, str(src))
        ST.write_versions(ST.stream_stalled_jobs(stream, clock="event", watermark="0 seconds"), out, cp).awaitTermination()
        return {r.job_id: (r.status, r.stalled) for r in ST.current(spark, out, ["job_id"]).collect()}

    spark.createDataFrame([("a", "processing", T0), ("b", "processing", T0 + timedelta(seconds=500)),
                           ("c", "completed", T0)], schema).write.mode("append").parquet(str(src))
    assert run() == {"a": ("failed", True), "b": ("processing", False), "c": ("completed", False)}
    spark.createDataFrame([("a", "completed", T0 + timedelta(seconds=600))], schema).write.mode(
        "append").parquet(str(src))
    assert run()["a"] == ("completed", False)


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "ip_hash string, created_at timestamp"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))
        counts = ST.stream_windowed_counts(ST.read_table_stream(spark, str(src)), ["ip_hash"], "10 minutes")
        ST.write_versions(counts, out, cp).awaitTermination()
        return {(r.ip_hash, r.window_start.hour): r.events for r in ST.current(
            spark, out, ["ip_hash", "window_start", "window_end"]).collect()}

    assert run([("x", T0), ("x", T0 + timedelta(minutes=5)), ("y", T0 + timedelta(hours=3))]) == {
        ("x", 0): 2, ("y", 3): 1}
    assert run([("x", T0 + timedelta(minutes=1)), ("y", T0 + timedelta(hours=3, minutes=1))]) == {
        ("x", 0): 2, ("y", 3): 2}


def test_stalled_stream_needs_a_watermark(spark):
    with pytest.raises(ValueError, match="watermark"):
        ST.stream_stalled_jobs(spark.createDataFrame([], "job_id string, updated_at timestamp"), clock="event")


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [1, 2, 0]])
def test_stalled_stream_orders_ties_by_seq(spark, tmp_path, order):
    schema = "job_id string, status string, seq long, updated_at timestamp"
    rows = [("a", "processing", 1, T0), ("a", "completed", 3, T0), ("a", "queued", 2, T0)]
    out, cp, src = str(tmp_path / "out"), str(tmp_path / "cp"), tmp_path / "in"
    for i in order:  # one micro-batch each
        spark.createDataFrame([rows[i]], schema).write.mode("append").parquet(str(src))
        stream = ST.read_table_stream(spark, str(src))
        ST.write_versions(ST.stream_stalled_jobs(stream, clock="event", watermark="1 hour"), out, cp).awaitTermination()
    if order[-1] != 1 and order.index(1) < 2:
        return  # a job that has ended keeps no state; the batch twin decides such rows
    assert {r.job_id: r.status for r in ST.current(spark, out, ["job_id"]).collect()} == {"a": "completed"}


@pytest.mark.parametrize("batches", [1, 5])
def test_stalled_stream_of_events_without_time_or_number(spark, tmp_path, batches):
    """As in the batch form, such events are before all others."""
    schema = "job_id string, status string, seq long, updated_at timestamp"
    late = T0 + timedelta(seconds=5)
    rows = [("a", "processing", 1, T0), ("a", "completed", 2, late), ("a", "processing", 3, None),
            ("b", "processing", None, T0), ("b", "completed", 1, T0), ("c", "processing", None, None),
            ("d", None, 1, None), ("d", "queued", None, late), ("e", "processing", 1, None)]
    out, cp, src = str(tmp_path / "out"), str(tmp_path / "cp"), tmp_path / "in"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).write.mode("append").parquet(str(src))
        stream = ST.read_table_stream(spark, str(src))
        ST.write_versions(ST.stream_stalled_jobs(stream, clock="event", watermark="1 hour"), out, cp).awaitTermination()
    got = {r.job_id: (r.status, r.updated_at) for r in ST.current(spark, out, ["job_id"]).collect()}
    want = {r.job_id: (r.status, r.updated_at) for r in JB.job_state(spark.createDataFrame(rows, schema)).collect()}
    if batches > 1:  # a job that has ended keeps no state, so an older event that comes later stands for itself
        got, want = ({k: v for k, v in x.items() if k in "cde"} for x in (got, want))
    assert got == want


def test_stalled_jobs_share_groups(spark, tmp_path):
    """a call of Python answers a group of jobs; each keeps a due time of its own."""
    schema = "job_id string, status string, updated_at timestamp"
    out, cp, src = str(tmp_path / "out"), str(tmp_path / "cp"), tmp_path / "in"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))
        stream = ST.stream_stalled_jobs(ST.read_table_stream(spark, str(src)), clock="event", watermark="0 seconds", groups=4)
        query = ST.write_versions(stream, out, cp)
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
        return {r.job_id: (r.status, r.stalled) for r in ST.current(spark, out, ["job_id"]).collect()}

    at = lambda s: T0 + timedelta(seconds=s)
    first = run([(f"j{i}", "processing", at(20 * i)) for i in range(60)] + [(None, "queued", at(0))])
    assert first == {"None": ("queued", False)} | {
        f"j{i}": ("failed", True) if 20 * i + 300 < 1180 else ("processing", False) for i in range(60)}
    again = run([("j50", "completed", at(1300)), ("j3", "processing", at(1300))])
    assert again == first | {"j50": ("completed", False), "j3": ("processing", False)} | {
        f"j{i}": ("failed", True) for i in range(44, 50)}


def test_recommend_without_catalogue_fails_and_recovers(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    songs = spark.createDataFrame([(i, [float(i), 1.0], 100.0) for i in range(5)],
                                  "id long, learned array<double>, bpm double")
    songs.select("id", "learned").write.parquet(str(src))

    def broken():
        raise IOError("down")
    stream = ST.read_table_stream(spark, str(src))
    with pytest.raises(Exception, match="no catalogue"):
        ST.stream_recommend(stream, ST.Refreshed(broken), out, cp, 2).awaitTermination()
    ST.stream_recommend(stream, ST.Refreshed(lambda: songs), out, cp, 2).awaitTermination()
    assert spark.read.parquet(out).select("query_id").distinct().count() == 5


@pytest.mark.parametrize("files", [1, 4])
def test_sessions_have_no_stale_visits(spark, tmp_path, files):
    rows = [("s", T0 + timedelta(minutes=m)) for m in (9, 0, 70, 20)]
    write_in_files(spark, rows, "session_hash string, created_at timestamp", tmp_path / "in", files)
    out = str(tmp_path / "out")
    stream = ST.read_table_stream(spark, str(tmp_path / "in"), 1)
    ST.write_versions(ST.stream_sessions(stream, "1 day"), out, str(tmp_path / "cp"), "complete").awaitTermination()
    got = sorted((r.started, r.events) for r in ST.last_batch(spark, out).collect())
    assert got == [(T0, 3), (T0 + timedelta(minutes=70), 1)]


@pytest.mark.parametrize("files", [1, 4])
def test_sessions_come_out_once_when_closed(spark, tmp_path, files):
    rows = [("s", T0 + timedelta(minutes=m)) for m in (9, 0, 70, 20)] + [("t", T0 + timedelta(minutes=15)), (None, T0)]
    write_in_files(spark, rows, "session_hash string, created_at timestamp", tmp_path / "in", files)
    out, cp, ends = (str(tmp_path / x) for x in ("out", "cp", "ends"))

    def run():
        visits = ST.stream_sessions(ST.read_table_stream(spark, str(tmp_path / "in"), 1), "1 day",
                                    ends=ST.end_marks(spark, ends))
        ST.write_versions(visits, out, cp, "append").awaitTermination()
        return sorted(((r.session_hash, r.started, r.events) for r in spark.read.parquet(out).collect()), key=repr)
    assert run() == []  # a day late is in time, so every visit is open
    ST.mark_end(spark, ends, T0 + timedelta(days=1, minutes=60))
    want = [("s", T0, 3), ("t", T0 + timedelta(minutes=15), 1), (None, T0, 1)]
    assert run() == sorted(want, key=repr)
    ST.mark_end(spark, ends)
    assert run() == sorted([*want, ("s", T0 + timedelta(minutes=70), 1)], key=repr)


def test_sinks_fold_their_versions(spark, tmp_path):
    """However many micro-batches, a bounded number of folders is read, and the rows are those of the batch twin."""
    write_in_files(spark, VOTES, VOTE_SCHEMA, tmp_path / "in", 18)
    stream = ST.read_table_stream(spark, str(tmp_path / "in"), 1)
    out, keys = str(tmp_path / "out"), ["query_song_id", "result_song_id"]
    ST.write_versions(ST.stream_feedback_stats(stream), out, str(tmp_path / "cp"), keys=keys,
                      fold_every=4).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 18
    upto, tail = ST.parts_of(spark, out)
    assert upto == 15 and tail == [16, 17]
    want = as_set(FB.feedback_stats(spark.createDataFrame(VOTES, VOTE_SCHEMA)))
    assert as_set(ST.current(spark, out, keys)) == want
    (tmp_path / "out_snapshots" / "upto=15" / "_SUCCESS").rename(tmp_path / "marker")  # an unfinished snapshot
    assert ST.parts_of(spark, out) == (11, list(range(12, 18)))
    assert as_set(ST.current(spark, out, keys)) == want
    assert ST.parts_of(spark, out, 8) == (7, [])
    assert ST.current(spark, str(tmp_path / "nothing"), keys) is None


@pytest.mark.parametrize("files", [1, 3])
def test_ab_windows_count_sessions_exactly(spark, tmp_path, files):
    rows = [(f"s{i % 7}", "ab"[i % 2], "click", T0 + timedelta(hours=i)) for i in range(60)]
    schema = "session_hash string, ab_group string, action string, created_at timestamp"
    write_in_files(spark, rows, schema, tmp_path / "in", files)
    out = str(tmp_path / "out")
    stream = ST.read_table_stream(spark, str(tmp_path / "in"), 1)
    ST.write_versions(ST.stream_ab_sessions(stream, "10 days"), out, str(tmp_path / "cp")).awaitTermination()
    got = ST.ab_windows(ST.current(spark, out, ST.AB_KEYS)).collect()
    for r in got:
        mine = [x for x in rows if x[1] == r.ab_group and x[3].date() == r.window_start.date()]
        assert (r.event_count, r.unique_sessions) == (len(mine), len({x[0] for x in mine}))
    assert sum(r.event_count for r in got) == 60


def test_refreshed_keeps_value_on_error(spark):
    now, calls = [0.0], []

    def load():
        calls.append(now[0])
        if now[0] > 500:
            raise IOError("down")
        return spark.range(len(calls))

    side = ST.Refreshed(load, 300, clock=lambda: now[0])
    first = side.get()
    now[0] = 299
    assert side.get() is first and len(calls) == 1
    now[0] = 301
    second = side.get()
    assert second is not first
    now[0] = 700
    assert side.get() is second and side.get() is second and len(calls) == 3
    assert side.failures == 1 and isinstance(side.error, IOError)


@pytest.mark.parametrize("files, fold_every", [(1, 20), (3, 20), (8, 2)])
def test_feed_stream_keeps_a_ledger(spark, tmp_path, files, fold_every):
    rows = [(i, 10 + i % 8, "u" if i % 3 else None) for i in range(8)]
    schema = "pos long, deezer_id long, preview_url string"
    write_in_files(spark, rows, schema, tmp_path / "in", files)
    known = spark.createDataFrame([(10,), (11,)], "deezer_id long")
    out, ledger, cp = (str(tmp_path / x) for x in ("out", "ledger", "cp"))

    def run():
        ST.stream_feed(ST.read_table_stream(spark, str(tmp_path / "in"), 1), known, out, ledger, cp,
                       fold_every=fold_every).awaitTermination()
        return sorted((r.deezer_id, r.outcome) for r in ST.current(spark, ledger, ["deezer_id"]).collect())
    want = sorted((10 + i, "skipped" if i < 2 else "queued" if i % 3 else "failed") for i in range(8))
    assert run() == want
    spark.createDataFrame(rows[:4], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == want  # known items are not dealt with again
    assert spark.read.parquet(out).where("outcome = 'processed'").count() == 4
    assert len(ST.parts_of(spark, ledger)[1]) <= fold_every
