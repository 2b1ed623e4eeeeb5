"""Sources, catalogue jobs, text resolution, graph growth and jobs on small fixtures."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundalike.operators import catalog as K
from soundalike.operators import evaluate as E
from soundalike.operators import expand as EX
from soundalike.operators import identify as ID
from soundalike.operators import jobs as JB
from soundalike.operators import listing as LS
from soundalike.operators import playlist as PL
from soundalike.operators import rules as RU
from soundalike.operators import stats as ST
from soundalike.sources import readers as RD
from soundalike.sources import sinks as SK


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ------------------------------------------------------------------------ sources

def test_feature_file(spark, tmp_path):
    good = {"_tid": "7", "title": "T", "learned_embedding": "[1.0, 2.0]", "handcrafted_raw": "[3.0]"}
    lines = [json.dumps(good), "", "{broken", json.dumps({**good, "_tid": "8", "learned_embedding": "[1]"})]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    ok, bad = RD.read_features_jsonl(spark, str(tmp_path), learned_dim=2, handcrafted_dim=1)
    assert rows(ok, "deezer_id", "title", "learned") == [(7, "T", [1.0, 2.0])]
    assert sorted(r.reason for r in bad.collect()) == ["learned_dim", "malformed"]


def test_raw_tracks_multiline(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'track_id,track_title,artist_name,album_title,track_duration,track_genres,'
        'track_date_recorded,track_date_created\n'
        '2,"A ""quoted""\ntitle", Artist ,,02:48,"[{\'genre_id\': \'21\', \'genre_title\': \'Hip-Hop\'}]",,'
        '11/26/2008 01:48:12 AM\n'
        'x9,nope,a,b,c,d,e,f\n')
    t = RD.read_fma_tracks(spark, str(tmp_path))
    parents = spark.createDataFrame([("Hip-Hop", "Urban")], "title string, top string")
    m = K.track_metadata(t, parents).collect()
    assert len(m) == 1
    assert (m[0].track_id, m[0].track_title, m[0].artist_name) == (2, 'A "quoted"\ntitle', "Artist")
    assert (m[0].duration_sec, m[0].release_year, m[0].sub_genre, m[0].genre) == (168, 2008, "Hip-Hop", "Urban")
    d = K.metadata_defaults(t).first()
    assert (d.title, d.album) == ('A "quoted"\ntitle', None)


def test_two_row_header(spark, tmp_path):
    (tmp_path / "tracks.csv").write_text(
        ",set,set,track\n,split,subset,genre_top\ntrack_id,,,\n"
        "2,training,small,Rock\n3,training,large,Rock\n5,test,small,\n10,test,small,Pop\n")
    assert rows(RD.read_fma_subset(spark, str(tmp_path)), "track_id", "genre_top") == [
        (10, "Pop"), (2, "Rock")]


def test_csv_files_of_any_size_and_column_order(spark, tmp_path):
    """Records are found across ranges of a file, and each file is read by its own header."""
    want = []
    for n, order in enumerate((["track_id", "track_title", "artist_name"], ["track_title", "track_id", "artist_name"])):
        lines = [",".join(order) + "\r\n"]
        for i in range(4000):
            row = {"track_id": str(n * 10000 + i), "artist_name": f"a, {i}",
                   "track_title": f'say ""{i}""\nline two\n\nline "" four' if i % 7 == 0 else f"t{i}"}
            lines.append(",".join(f'"{row[c]}"' if c != "track_id" else row[c] for c in order) + "\r\n")
            want.append((int(row["track_id"]), row["track_title"].replace('""', '"'), row["artist_name"]))
        (tmp_path / f"f{n}.csv").write_bytes((b"\xef\xbb\xbf" if n else b"") + "".join(lines).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        t = RD.read_fma_tracks(spark, str(tmp_path))
        got = sorted(map(tuple, t.select("track_id", "track_title", "artist_name").collect()))
        ranges = RD.csv_records._lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(want) and ranges > 10


def test_csv_without_a_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("track_id,track_title\n1,x\nno,y\n")
    assert rows(RD.read_fma_tracks(spark, str(tmp_path)), "track_id", "track_title", "artist_name") == [(1, "x", "")]
    assert RD.dropped_tracks(spark, str(tmp_path)).first().dropped == 1
    with pytest.raises(ValueError, match="genre_id"):
        RD.read_fma_genres(spark, str(tmp_path))
    with pytest.raises(ValueError, match="set"):
        RD.read_fma_subset(spark, str(tmp_path))
    (tmp_path / "g").mkdir()
    (tmp_path / "g/1.csv").write_text("genre_id,title,top_level\n1,Rock,1\n")
    (tmp_path / "g/2.csv").write_text('top_level,genre_id,title\n1,2,"Hard, Rock"\n')
    assert rows(RD.read_fma_genres(spark, str(tmp_path / "g")), "genre_id", "title", "top_level") == [
        (1, "Rock", 1), (2, "Hard, Rock", 1)]


def test_tag_and_meta_lines(spark, tmp_path):
    (tmp_path / "g.tsv").write_text(
        "TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS\n"
        "track_1\ta\tb\t14/1.mp3\t12.5\tgenre---rock\tmood---x\tgenre---techno\n"
        "track_2\ta\tb\t14/2.mp3\tbad\tgenre---pop\n"
        "track_3\ta\tb\t14/3.mp3\t9.0\n")
    tags = RD.read_jamendo_tags(spark, str(tmp_path / "g.tsv"))
    assert rows(tags, "track_id", "tag_duration", "tags") == [
        ("track_1", 12.5, ["rock", "techno"]), ("track_2", 0.0, ["pop"])]
    (tmp_path / "m.tsv").write_text(
        "TRACK_ID\tA\tB\tNAME\tARTIST\tALBUM\tDATE\ntrack_1\ta\tb\tT\tX\tY\t2004-12-28\n"
        "track_2\ta\tb\tT\tX\tY\tnone\n")
    meta = RD.read_jamendo_meta(spark, str(tmp_path / "m.tsv"))
    assert rows(meta, "track_id", "release_year") == [("track_1", 2004), ("track_2", None)]
    assert rows(LS.tag_selection(tags, meta, 2005), "track_id", "outcome") == [
        ("track_1", "too_old"), ("track_2", "no_tag")]


def test_track_list_and_audio(spark, tmp_path):
    (tmp_path / "tracks.json").write_text(json.dumps([{"deezer_id": 1, "title": "a"}, {"deezer_id": 2}]))
    assert rows(RD.read_track_list(spark, str(tmp_path / "tracks.json")), "deezer_id") == [(1,), (2,)]
    odd = [{"deezer_id": i, "title": t, "album": "x" * (i % 50)} for i, t in enumerate([
        'a } b', '{"', '\\"}{', '\\\\', '}}{{', '', 'line\n}', '\u00e9}', '[{"deezer_id": 99}]'] * 40)]
    for n, (layout, many) in enumerate([(None, False), (2, False), (None, True)]):
        text = "\n".join(json.dumps([o]) for o in odd) if many else json.dumps(odd, indent=layout)
        path = tmp_path / f"odd{n}.json"
        path.write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 10)  # many ranges, cut anywhere
        try:
            read = RD.read_track_list(spark, str(path))
            assert read.rdd.getNumPartitions() > 4
            assert rows(read, "deezer_id", "title", "album") == sorted(
                ((o["deezer_id"], o["title"], o["album"]) for o in odd), key=repr)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "none.json").write_text("[]\n")
    assert RD.read_track_list(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "deep.json").write_text('[{"a": {"b": {}}, "deezer_id": 7}, 5, null, {"deezer_id": "x"}, {}]')
    assert rows(RD.read_track_list(spark, str(tmp_path / "deep.json")), "deezer_id") == [(7,), (None,), (None,)]
    for name in ("000/000002.mp3", "000/cover.mp3", "14/5.low.mp3"):
        f = tmp_path / "audio" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    files = RD.list_audio(spark, str(tmp_path / "audio"))
    assert rows(RD.audio_inventory(files), "track_id", "length") == [(2, 1)]
    tracks = spark.createDataFrame([("14/5.mp3",), ("14/6.mp3",)], "path string")
    rel = files.select(F.regexp_extract("path", r"audio/(.*)$", 1).alias("rel_path"))
    assert rows(RD.match_audio(tracks, rel), "path", "audio_path") == [
        ("14/5.mp3", "14/5.low.mp3"), ("14/6.mp3", None)]
    assert spark.range(2, 3).select(RD.conventional_path(F.col("id"))).first()[0] == "000/000002.mp3"


def test_stats_shapes_and_floor(spark):
    cfg = spark.createDataFrame([
        ("normalization_stats", '{"mean":[1.0],"std":[2.0],"dim":1,"n_songs":3}'),
        ("handcrafted_norm_stats", '{"means":[4.0],"stds":[5.0],"dim":1}')], "key string, value string")
    assert rows(RD.read_stats(cfg), "mean", "std") == [([1.0], [2.0]), ([4.0], [5.0])]
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],), (None,)], "handcrafted_raw array<double>")
    for mode, floor in (("greatest", 1e-10), ("one", 1.0), ("zero", 1.0)):
        s = ST.fit_stats(v, dim=2, floor_mode=mode).first()
        assert (s.mean, s.std, s.n_songs) == ([1.0, 3.0], [floor, 1.0], 2)
    wide = spark.createDataFrame([([float(i)] * 200,) for i in (1, 3)], "handcrafted_raw array<double>")
    s = ST.fit_stats(wide, dim=200).first()
    assert s.mean == [2.0] * 200 and s.std == [1.0] * 200 and s.n_songs == 2


def test_feature_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", [0.5, 1.0], [2.0])], "_tid string, learned array<double>, handcrafted_raw array<double>")
    SK.write_features(df, str(tmp_path / "out"))
    ok, _ = RD.read_features_jsonl(spark, str(tmp_path / "out"), learned_dim=2, handcrafted_dim=1)
    assert rows(ok, "deezer_id", "learned") == [(1, [0.5, 1.0])]


# ------------------------------------------------------------------- imports, jobs

def test_import_keeps_first_and_all_keyless_rows(spark):
    have = spark.createDataFrame([(1, 10)], "id long, deezer_id long")
    new = spark.createDataFrame(
        [(1, 10, "a", "x"), (2, 11, "b", "x"), (3, 11, "c", "x"), (4, None, "d", "x"), (5, None, "d", "x"),
         (6, 12, None, "x"), (7, 13, "t" * 501, "x")], "seq long, deezer_id long, title string, artist string")
    good, bad = RU.validate(new, RU.song_rules())
    assert rows(K.import_new(have, good), "seq", "source") == [(2, "unknown"), (4, "unknown"), (5, "unknown")]
    assert rows(bad, "seq", "reasons") == [(6, ["title_missing"]), (7, ["title_too_long"])]
    assert K.import_report(have, new).first().asDict() == {
        "attempted": 7, "rejected": 2, "inserted": 3, "skipped": 2}


def test_classify(spark):
    songs = spark.createDataFrame([(1, "FMA Track 5"), (2, "Same"), (3, "nowhere"), (4, "FMA Track 99"),
                                   (5, "Old")], "id long, title string")
    meta = spark.createDataFrame([
        (5, "", "Electronic", "Techno", None, 0), (6, "Same", "Electronic", "Chiptune", 2010, 1),
        (7, "Same", "Electronic", "Techno", 2010, 2), (8, "Old", "Electronic", "Techno", 1990, 3)],
        "track_id long, track_title string, genre string, sub_genre string, release_year int, row_no long")
    out = K.classify(songs, meta, excluded=["Chiptune"])
    assert rows(out, "id", "verdict") == [(1, "keep"), (2, "delete"), (3, "unmatched"),
                                          (4, "unmatched"), (5, "delete")]


def test_choose_candidate(spark):
    c = spark.createDataFrame([
        (1, 0, "p", "Red", "X", "blue", "x"), (1, 1, "", "Red", "X", "Dark Red", "xy"),
        (2, 0, "", "Red", "X", "blue", "x"), (2, 1, "p", "Red", "X", "green", "z"),
        (3, 0, "", "Red", "X", "blue", "x")],
        "request_id long, pos int, preview string, want_title string, want_artist string, cand_title string, cand_artist string")
    assert rows(K.choose_candidate(c), "request_id", "cand_title", "tier") == [(1, "Dark Red", 0), (2, "green", 1)]


def test_expand_catalog(spark):
    seeds = spark.createDataFrame([(1,), (2,)], "artist_id long")
    related = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (3, 1, 5), (2, 1, 1)],
                                    "artist_id long, pos int, related_id long")
    tracks = spark.createDataFrame([
        (1, 1, 100, "a", 1, "p"), (2, 1, 100, "a", 2, "p"), (3, 1, 300, "c", 1, "p"), (3, 2, 301, "c", 1, ""),
        (4, 1, 400, "d", 2, "p"), (5, 1, 500, "e", 1, "p")],
        "artist_id long, pos int, track_id long, title string, album_id long, preview string")
    albums = spark.createDataFrame([(1, 106, []), (2, 5, [(7, "x")])],
                                   "album_id long, genre_id int, genres array<struct<id int, name string>>")
    one = EX.expand_catalog(seeds, related, tracks, albums, depth=1)
    assert rows(one, "track_id", "artist_id") == [(100, 1), (300, 3)]
    two = EX.expand_catalog(seeds, related, tracks, albums, depth=2)
    assert rows(two, "track_id", "depth") == [(100, 0), (300, 1), (500, 2)]


def brute_identify(reqs, songs, title_pool):
    def words(x):
        return {w for w in x.split() if len(w) >= 3}

    def match(a, b):
        return bool(a and b and (a in b or b in a or words(a) & words(b)))
    out = {}
    for rid, a, t in reqs:
        a, t, hit = a.strip().lower(), t.strip().lower(), None
        ordered = sorted(songs)
        if a and t:
            hit = next((s[0] for s in ordered if a in s[2].lower() and t in s[1].lower()), None)
        if hit is None and t:
            pool = [s for s in ordered if t in s[1].lower()][:title_pool]
            hit = next((s[0] for s in pool if not a or match(a, s[2].strip().lower())), None)
        if hit is None and a and not t:
            hit = next((s[0] for s in ordered if a in s[2].lower()), None)
        out[rid] = hit
    return out


@pytest.mark.parametrize("pool", [10, None])
def test_identify_matches_brute_force(spark, pool):
    rng = random.Random(4)
    bits = ["red", "re", "a", "ab", "blue moon", "x", "moon", "%", "_", "the the", "é", "untitled"]
    name = lambda: " ".join(rng.choice(bits) for _ in range(rng.randint(1, 3)))
    songs = [(i, "untitled" if i % 3 == 0 else name().title(), name()) for i in range(150)]
    reqs = [(i, "" if rng.random() < .2 else name(), "" if rng.random() < .2 else
             ("untitled" if i % 3 == 0 else name())) for i in range(150)]
    got = ID.identify(spark.createDataFrame(reqs, "request_id long, artist string, title string"),
                      spark.createDataFrame(songs, "id long, title string, artist string"), clean=False, title_pool=pool)
    assert {r.request_id: r.song_id for r in got.collect()} == brute_identify(reqs, songs, pool)


def test_jobs(spark):
    t0 = datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        ("a", 1, "queued", 0.0, None, t0), ("a", 2, "processing", 0.1, None, t0 + timedelta(seconds=10)),
        ("a", 3, "completed", None, "done", t0 + timedelta(seconds=20)),
        ("b", 4, "processing", 0.5, None, t0)],
        "job_id string, seq long, status string, progress double, last_error string, updated_at timestamp")
    state = JB.job_state(ev)
    got = {r.job_id: r for r in state.collect()}
    assert (got["a"].status, got["a"].progress, got["a"].last_error) == ("completed", 0.1, "done")
    assert got["a"].completed_at == t0 + timedelta(seconds=20) and got["b"].completed_at is None
    for sec, want in ((300, "processing"), (301, "failed")):
        out = {r.job_id: r for r in JB.stalled_jobs(state, F.lit(t0 + timedelta(seconds=sec))).collect()}
        assert out["b"].status == want and out["a"].status == "completed"


@pytest.mark.parametrize("cap", [0, 150, 420, 10_000])
def test_retention_matches_brute_force(spark, cap):
    rng = random.Random(cap)
    now = datetime(2024, 1, 10)
    files = [(str(i), rng.randint(1, 30), now - timedelta(hours=rng.choice([1, 2, 30, 30]))) for i in range(60)]
    jobs = [(str(i), rng.choice(["completed", "failed", "processing", "queued"])) for i in range(0, 60, 2)]
    state = dict(jobs)
    want, left = {}, []
    for stem, size, at in files:
        if state.get(stem) in ("completed", "failed"):
            want[stem] = "finished"
        elif stem not in state and (now - at).total_seconds() > 24 * 3600:
            want[stem] = "orphan"
        else:
            left.append((at, stem, size))
    total = sum(x[2] for x in left)
    for at, stem, size in sorted(left):
        want[stem] = "keep"
        if total > cap and stem not in state:
            total -= size
            want[stem] = "over_cap"
    plan = JB.retention_plan(
        spark.createDataFrame(files, "stem string, size long, modified timestamp"),
        spark.createDataFrame(jobs, "job_id string, status string"), F.lit(now), cap_bytes=cap, slices=3)
    assert {r.stem: r.action for r in plan.collect()} == want


def test_playlist(spark):
    e = spark.createDataFrame([(1, 1, "A", "T", 120.0, "A minor", 0.5), (1, 2, "B", "U", None, None, None),
                               (1, 3, "C", "V", 125.5, "", 0.2)],
                              "playlist_id long, position int, artist string, title string, bpm double, musical_key string, intensity double")
    assert PL.playlist_text(e).first().text == "1. A — T | 120 BPM | A minor\n2. B — U\n3. C — V | 126 BPM"
    f = {r.position: r for r in PL.playlist_flow(e).collect()}
    assert (f[1].min_bpm, f[1].max_bpm, f[2].x) == (120.0, 125.5, 0.5)
    assert f[1].bpm_level == 0 and f[3].bpm_level == pytest.approx(0.55)
    p = {r.position: r for r in PL.flow_points(PL.playlist_flow(e)).collect()}
    assert (p[1].x, p[1].bpm_y) == (20.0, 80.0)


# ---------------------------------------------------------------------- evaluation

def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=2) + 3 * (i % 2)]) for i in range(40)]
    pts.append((40, "lone", [9.0, 9.0]))
    df = spark.createDataFrame(pts, "id long, genre string, learned array<double>")
    xy = np.array([p[2] for p in pts])
    lab = np.array([p[1] for p in pts])
    scores = []
    for i in range(len(pts)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        same = (lab == lab[i]) & (np.arange(len(pts)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[same].mean()
        b = min(d[lab == c].mean() for c in set(lab) if c != lab[i])
        scores.append((b - a) / max(a, b))
    got = E.sample_silhouette(df, 2000).first()
    assert got.silhouette == pytest.approx(float(np.mean(scores))) and got.labels == 3


def test_silhouette_of_all_points(spark):
    rng = np.random.default_rng(3)
    pts = [(i, "abc"[i % 3], float(rng.normal() + i % 3), float(rng.normal())) for i in range(50)] + [(99, "lone", 9.0, 9.0)]
    xy, lab = np.array([p[2:] for p in pts]), np.array([p[1] for p in pts])
    scores = []
    for i in range(len(pts)):
        d = ((xy - xy[i]) ** 2).sum(1)
        same = (lab == lab[i]) & (np.arange(len(pts)) != i)
        a = d[same].mean() if same.any() else 0
        b = min(d[lab == c].mean() for c in set(lab) - {lab[i]})
        scores.append((b - a) / max(a, b) if same.any() else 0.0)
    got = E.silhouette_of(spark.createDataFrame(pts, "id long, label string, x double, y double")).first()
    assert got.silhouette == pytest.approx(float(np.mean(scores))) and (got.rows, got.labels) == (51, 4)


@pytest.mark.parametrize("values", [[1.0], [2.0] * 9, [0.0, 1.0], list(np.random.default_rng(5).normal(size=999)),
                                    [0.0] * 500 + [1e9] + [0.5] * 3])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    assert E.percentiles(df, "v", shares) == pytest.approx([float(np.quantile(values, p)) for p in shares])


def test_percentiles_of_many_rows_with_an_outlier(spark):
    """The outlier takes no part in how the work is spread: only values near the wanted ranks are sorted."""
    n = 60_000
    df = spark.range(n).select((F.xxhash64("id") % 1_000_003 / 1e6).alias("v")).unionByName(
        spark.createDataFrame([(1e9,)], "v double")).cache()
    values = [r.v for r in df.collect()]
    assert E.percentiles(df, "v", [0.05, 0.5, 0.999]) == pytest.approx([float(np.quantile(values, p)) for p in (0.05, 0.5, 0.999)])


def test_axis_ratios(spark):
    v = np.random.default_rng(2).normal(size=(200, 5)) * [1, 3, 2, 0.5, 1]
    df = spark.createDataFrame([(x.tolist(),) for x in v] + [(None,)], "learned array<double>")
    want = np.sort(v.var(axis=0))[::-1] / v.var(axis=0).sum()
    got = E.axis_ratios(df).orderBy("pc").collect()
    assert [r.ratio for r in got] == pytest.approx(want.tolist()) and got[-1].cumulative == pytest.approx(1)


def test_playlist_text_in_pieces(spark):
    e = spark.createDataFrame([(p, i, "A", f"T{i}", None, None) for p in (1, 2) for i in range(1, 8 * p)],
                              "playlist_id long, position long, artist string, title string, bpm double, musical_key string")
    got = PL.playlist_text(e, 5).orderBy("playlist_id", "chunk").collect()
    assert [(r.playlist_id, r.chunk) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert "\n".join(r.text for r in got[2:]) == "\n".join(f"{i}. A — T{i}" for i in range(1, 16))


def test_song_pairs_cover_all_songs(spark):
    df = spark.range(300).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("learned"))
    pairs = E.song_pairs(df, rounds=3, buckets=8).collect()
    assert len(pairs) == 900 and all(p.id_a != p.id_b for p in pairs)
    assert len({p.id_a for p in pairs}) == 300 and all(p.learned_b[0] == p.id_b for p in pairs)
    assert E.song_pairs(df.limit(0)).count() == 0
    sliced = E.song_pairs(df, rounds=3, buckets=8, slice_rows=3).collect()  # some slices are empty
    assert {(p.id_a, p.id_b) for p in sliced} == {(p.id_a, p.id_b) for p in pairs} and len(sliced) == 900
    one = E.song_pairs(df.limit(2), rounds=2, buckets=1, slice_rows=1).collect()
    assert sorted((p.id_a, p.id_b) for p in one) == [(0, 1), (0, 1), (1, 0), (1, 0)]


def test_pca_of_nothing(spark):
    assert E.pca_ratios(spark.createDataFrame([], "id long, learned array<double>")).count() == 0


def test_stats_leave_out_other_widths(spark):
    v = spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],), ([9.0],), ([1.0, 1.0, 7.0],), (None,)],
                              "handcrafted_raw array<double>")
    s = ST.fit_stats(v, dim=2).first()
    assert (s.mean, s.n_songs) == ([2.0, 2.0], 2)
    assert rows(ST.rejected_widths(v, dim=2), "width", "count") == [(1, 1), (3, 1)]


def test_repeated_keys_do_not_multiply_rows(spark):
    songs = spark.createDataFrame([(1, None), (2, [5.0])], "id long, mert array<double>")
    vecs = spark.createDataFrame([(1, [2.0]), (1, [1.0]), (2, [9.0])], "id long, vector array<double>")
    assert rows(K.update_vectors(songs, vecs), "id", "mert") == [(1, [1.0]), (2, [5.0])]
    results = spark.createDataFrame([(1, None, "no_preview"), (1, [1.0], None)], "id long, vector array<double>, error string")
    done = spark.createDataFrame([(2,), (2,)], "id long")
    assert rows(K.vector_outcomes(songs, results, done), "id", "outcome") == [(1, "extracted"), (2, "skipped")]
    up = spark.createDataFrame([("j1",)], "job_id string")
    found = spark.createDataFrame([("j1", "b", "T2", "A", None), ("j1", "a", "T1", "A", None)],
                                  "job_id string, recording_id string, title string, artist string, album string")
    assert rows(K.enrich(up, found), "title") == [("T1",)]
    meta = spark.createDataFrame([(7, "X", "Pop", None, 2001, 1), (7, "X", "Electronic", None, 2005, 2)],
                                 "track_id long, track_title string, genre string, sub_genre string, release_year int, row_no long")
    named = spark.createDataFrame([(1, "FMA Track 7")], "id long, title string")
    assert rows(K.classify(named, meta), "id", "new_genre", "verdict") == [(1, "Electronic", "keep")]


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0]])
def test_import_over_several_keys(spark, order):
    given = [(1, 1, 1), (2, 2, 1), (3, 2, 3), (4, None, 3), (5, None, None)]
    incoming = spark.createDataFrame(given, "seq long, deezer_id long, musicbrainz_id long")
    existing = spark.createDataFrame([(50, 50)], "deezer_id long, musicbrainz_id long")
    out = K.import_new(existing, incoming, keys=("deezer_id", "musicbrainz_id"))
    assert rows(out, "seq") == [(1,), (3,), (5,)]  # 2 is blocked by 1, so it does not block 3


def test_feed_positions_may_repeat_or_be_missing(spark):
    work = spark.createDataFrame([(1, 10, "u"), (1, 11, "u"), (2, 12, "u"), (None, 13, "u")],
                                 "pos long, deezer_id long, preview_url string")
    none = spark.createDataFrame([], "deezer_id long")
    got = rows(K.feed(work, none, limit=2), "deezer_id", "outcome")
    assert got == [(10, "queued"), (11, "queued"), (12, "beyond_limit"), (13, "beyond_limit")]
    assert [r[1] for r in rows(K.feed(work, none, limit=4), "deezer_id", "outcome")] == ["queued"] * 4


def test_pca_profile(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * np.array([5, 2, 1, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "id long, learned array<double>")
    ev = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    ratio = ev / ev.sum()
    p = E.pca_profile(E.pca_ratios(df)).first()
    assert p.pc1 == pytest.approx(ratio[0]) and p.pc1_2 == pytest.approx(ratio[:2].sum())
    assert p.pcs_90 == int(np.searchsorted(np.cumsum(ratio), 0.9)) + 1
    assert p.effective_dim == pytest.approx(float(np.exp(-(ratio * np.log(ratio + 1e-10)).sum())))


def test_pair_sample_has_no_self_pairs(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("learned"))
    pairs = E.pair_sample(df, n_pairs=120).collect()
    assert len(pairs) == 120 and all(p.id_a != p.id_b for p in pairs)
    assert len(E.pair_sample(df.where("id < 3"), n_pairs=5000).collect()) == 3


def test_compare_models():
    out = E.compare_models(0.3, 0.2, 0.1, 20)
    assert out == {"agreement": "weak", "better_spread": True, "higher_dimension": True,
                   "complementary": True, "worse_spread": False}


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.8,), (0.85,), (1.0,), (0.1,)], "s double")
    got = {r["bin"]: (r["count"], r["share"]) for r in E.histogram(df, "s").collect()}
    assert got[0] == (1, 0.25) and got[1] == (1, 0.25) and got[6] == (1, 0.25) and got[2] == (0, 0.0)
