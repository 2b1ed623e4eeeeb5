"""Column builders against the expected values of the reference's own cases."""

import math

import pytest
from pyspark.sql import functions as F

from soundalike.functions import harmonic as H
from soundalike.functions import links as LK
from soundalike.functions import text as X
from soundalike.functions import vectors as C
from soundalike.functions.radar import radar_scores
from soundalike.operators.rank import fusion_weights


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, value, fn, kind="string"):
    return values(spark, [(value,)], f"x {kind}", fn("x").alias("y"))[0][0]


@pytest.mark.parametrize("title,base", [
    ("Café Del Mar (Deadmau5 Remix)", "café del mar"),
    ("Children [Mix Cut]", "children"),
    ("Silence (ASOT 1170) (Tiësto Remix)", "silence"),
    ("Strobe - Radio Edit", "strobe"),
    ("Strobe – Extended", "strobe"),
    ("Strobe - feat. Somebody Else", "strobe"),
    ("Plain", "plain"),
])
def test_base_title(spark, title, base):
    assert one(spark, title, X.base_title) == base


def test_cosine_edge_cases(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]),
            ([0.0, 0.0], [1.0, 2.0]), (None, [1.0, 2.0])]
    got = values(spark, rows, "a array<double>, b array<double>", C.cosine("a", "b"))
    assert [g[0] for g in got[:4]] == pytest.approx([1, 0, -1, 0])
    assert got[4][0] is None


def test_unit_keeps_zero_vector(spark):
    got = values(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>", C.unit("v"),
                 C.unit("v", 1e-10))
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[1][0] == [0.0, 0.0]
    assert got[1][1] == [0.0, 0.0]


def test_parse_vector(spark):
    assert one(spark, "[0.1,0.2,0.3]", C.parse_vector) == pytest.approx([0.1, 0.2, 0.3])
    assert one(spark, "nope", C.parse_vector) is None
    assert one(spark, None, C.parse_vector) is None


def test_zscore(spark):
    rows = [([1.0, 5.0], [0.0, 5.0], [2.0, 0.0]), ([1.0, 5.0], None, None)]
    got = values(spark, rows, "v array<double>, m array<double>, s array<double>",
                 C.zscore("v", "m", "s"))
    assert got[0][0] == [0.5, 0.0] and got[1][0] == [1.0, 5.0]


@pytest.mark.parametrize("focus,mert,weights,want", [
    (None, False, None, (0.80, 0.0, 0.20)),
    (None, True, None, (0.65, 0.15, 0.20)),
    ("timbre", False, None, (0.60, 0.0, 0.40)),
    ("timbre", True, None, (0.55, 0.15, 0.30)),
    (None, False, {"timbre": 0.3, "rhythm": 0.7}, (0.60, 0.0, 0.40)),
    (None, True, {"timbre": 0.3, "rhythm": 0.7}, (0.55, 0.15, 0.30)),
    (None, False, {"timbre": 0.25}, (0.70, 0.0, 0.30)),
    ("unknown", False, None, (0.80, 0.0, 0.20)),
])
def test_fusion_weights(spark, focus, mert, weights, want):
    w = fusion_weights(F.col("f"), F.col("m"), F.col("w"))
    got = values(spark, [(focus, mert, weights)], "f string, m boolean, w map<string,double>",
                 w.alias("w"))[0][0]
    assert tuple(got) == pytest.approx(want) and sum(got) == pytest.approx(1)


RADAR = [0.0] + [0.5] * 12 + [0.0] * 13 + [0.3] * 12 + [0.6, 0.7, 130.0, 0.4, 0.8, 0.6]


def test_radar(spark):
    s = radar_scores("v")
    got = values(spark, [(RADAR,), ([1.0] * 10,), ([9.0] * 44,)], "v array<double>",
                 *[c.alias(n) for n, c in s.items()])
    assert got[0] == pytest.approx((0.5, 0.3, 0.55, 0.65, 0.64))
    assert got[1] == (0, 0, 0, 0, 0)
    assert all(0 <= x <= 1 for x in got[2])


def test_artists_match(spark):
    rows = [("prok & fitch", "prok"), ("a b", "c d"), ("", "x"), ("daft punk", "punk band"),
            ("dj x", "dj y")]
    got = values(spark, rows, "a string, b string", X.artists_match("a", "b"))
    assert [g[0] for g in got] == [True, False, False, True, False]


@pytest.mark.parametrize("title,author,want", [
    ("Artist - Song Title", "Chan", ("Artist", "Song Title")),
    ("Song Title by Artist", "Chan", ("Artist", "Song Title")),
    ("Artist | Song Title", "Chan", ("Artist", "Song Title")),
    ("Song (Official Video)", "Chan - Topic", ("Chan", "Song")),
    ("A - B - C", "x", ("A", "B - C")),
])
def test_parse_video_title(spark, title, author, want):
    got = values(spark, [(title, author)], "t string, a string", X.parse_video_title("t", "a"))
    assert tuple(got[0][0]) == want


def test_parse_title(spark):
    rows = [("Artist - Title [Official Video]", ""), ("Title", "Someone"), ("Title", ""),
            ("(Live)", "Me")]
    got = values(spark, rows, "t string, a string", X.parse_title("t", "a"))
    assert [tuple(g[0]) for g in got] == [
        ("Artist", "Title"), ("Someone", "Title"), ("Unknown", "Title"), ("Me", "(Live)")]


def test_clean_title(spark):
    assert one(spark, "Song (Official Music Video) ft. X", X.clean_title) == "Song  feat. X"
    assert one(spark, "Song featuring X [HD]", X.clean_title) == "Song feat. X"


def test_durations_and_years(spark):
    for text, sec in (("3:20", 200.0), ("1:02:03", 3723.0), ("abc", None), ("", None), ("90", None)):
        assert one(spark, text, X.parse_duration) == sec
    for text, year in (("11/26/2008 01:48:12 AM", 2008), ("2004-12-28", 2004), ("1850-01-01", None),
                       ("", None), ("26-11-08", None)):
        assert one(spark, text, X.parse_year) == year


def test_genre_titles(spark):
    text = """[{'genre_id': '21', 'genre_title': 'Hip-Hop', 'genre_url': 'u'},
              {'genre_id': '4', 'genre_title': "Children's Music"}]"""
    assert one(spark, text, X.genre_titles) == ["Hip-Hop", "Children's Music"]
    assert one(spark, "[{'genre_title': 'x'", X.genre_titles) == []
    assert one(spark, None, X.genre_titles) == []


@pytest.mark.parametrize("url,fn,want", [
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", LK.video_id, "dQw4w9WgXcQ"),
    ("https://youtu.be/dQw4w9WgXcQ?t=1", LK.video_id, "dQw4w9WgXcQ"),
    ("https://www.youtube.com/shorts/dQw4w9WgXcQ", LK.video_id, "dQw4w9WgXcQ"),
    ("https://youtube.com.evil.test/watch?v=dQw4w9WgXcQ", LK.video_id, None),
    ("not a url", LK.video_id, None),
    ("https://open.spotify.com/intl-de/track/abc123?si=x", LK.spotify_id, "abc123"),
    ("https://open.spotify.com/album/abc", LK.spotify_id, None),
    ("https://soundcloud.com/a-b/c_d", LK.soundcloud_id, "a-b/c_d"),
    ("https://on.soundcloud.com/xyz", LK.soundcloud_id, "short"),
    ("https://music.apple.com/us/album/some-name/123?i=456", LK.apple_id, "456"),
    ("https://music.apple.com/us/album/some-name/123", LK.apple_id, None),
    ("https://music.apple.com/de/song/name/789", LK.apple_id, "789"),
    ("https://www.deezer.com/de/track/12345", LK.deezer_id, "12345"),
    ("https://link.deezer.com/s/abc", LK.deezer_id, "share"),
    ("https://music.apple.com/us/song/n/1" + "0" * 2100, LK.apple_id, None),
])
def test_link_ids(spark, url, fn, want):
    assert one(spark, url, fn) == want


@pytest.mark.parametrize("url,ok", [
    ("https://soundcloud.com/x", True), ("http://on.soundcloud.com/x", True),
    ("https://soundcloud.com.evil.test/x", False), ("ftp://soundcloud.com/x", False),
    ("https://evil.test/soundcloud.com", False), ("https://user@soundcloud.com:8080/x", True),
    ("https://notsoundcloud.com/", False), (None, False),
])
def test_host_allowed(spark, url, ok):
    assert one(spark, url, lambda c: LK.host_allowed(c, ["soundcloud.com"])) is ok


def test_harmonic(spark):
    rows = [("A minor", "A minor"), ("A minor", "E minor"), ("A minor", "C major"),
            ("A minor", "B minor"), ("A minor", "F# major"), ("A minor", "Am"),
            ("C# minor", "G# minor")]
    got = values(spark, rows, "a string, b string", H.harmonic_compatibility("a", "b"))
    assert [g[0] for g in got] == ["perfect", "perfect", "compatible", "compatible",
                                   "incompatible", None, "perfect"]
    assert one(spark, "Am", H.spell_key) == "A minor"
    assert one(spark, "Bb", H.spell_key) == "B-flat major"


def test_bpm(spark):
    rows = [(100.0, 101.0), (100.0, 104.0), (100.0, 120.0), (0.0, 100.0), (None, 100.0)]
    got = values(spark, rows, "a double, b double", H.bpm_match("a", "b"), H.bpm_difference("a", "b"))
    assert [g[0] for g in got] == ["exact", "close", "far", None, None]
    assert [g[1] for g in got] == [1, 4, 20, 100, None]
    assert values(spark, [(2.5, 0.0), (0.0, 2.5)], "a double, b double",
                  H.bpm_difference("a", "b")) == [(-2,), (3,)]


def test_nested_responses(spark):
    credits = "array<struct<name string, joinphrase string>>"
    assert one(spark, [("A", " & "), ("", "x"), ("B", None)], X.artist_credit, credits) == "A & B"
    results = "array<struct<recordings array<struct<id string>>>>"
    assert one(spark, [([],), (None,), ([("r1",), ("r2",)],)], X.first_recording, results) == "r1"


def test_grouped_similarity_of_itself(spark):
    v = [math.sin(i) for i in range(44)]
    got = values(spark, [(v, v)], "a array<double>, b array<double>", C.grouped_similarity("a", "b"))
    assert got[0][0] == pytest.approx(1.0)


# ------------------------------------------------------------------- trigrams

def plain_grams(name):
    import re
    out = set()
    for w in re.findall(r"[^\W_]+", name.lower()):
        padded = f"  {w} "
        out |= {padded[i:i + 3] for i in range(len(w) + 1)}
    return out


@pytest.mark.parametrize("percent", [30, 50, 80])
def test_similar_names_match_brute_force(spark, percent):
    import random

    from soundalike.operators import names as N
    r = random.Random(percent)
    words = ["a", "of", "the", "night", "nights", "light", "lights", "söng", "blue", "b", "c3"]
    hay = [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(120)] + ["", "?!", None, "a", "a"]
    needles = hay[:40] + ["a", "the", "nigth", "blue söngs", "", None, "a a a"]
    a = spark.createDataFrame([(x, i) for i, x in enumerate(needles)], "needle string, hay int")
    b = spark.createDataFrame([(x, i) for i, x in enumerate(hay)], "hay string, gram int")
    got = {(x.needle, x.hay): x.similarity for x in N.similar_names(a, b, percent).collect()}
    want = {}
    for x in {n for n in needles if n is not None}:
        for y in {h for h in hay if h is not None}:
            g, h = plain_grams(x), plain_grams(y)
            if g and h and 100 * len(g & h) >= percent * len(g | h):
                want[x, y] = len(g & h) / len(g | h)
    assert got == pytest.approx(want) and len(want) > 40
    with pytest.raises(ValueError):
        N.similar_names(a, b, 0)


def test_similar_names_meet_on_rare_trigrams_only(spark):
    from pyspark.sql import functions as F

    from soundalike.operators import names as N
    many = spark.range(3000).select(F.concat(F.lit("the song of "), F.md5(F.col("id").cast("string"))).alias("hay"))
    found = N.similar_names(many.select(F.col("hay").alias("needle")).limit(300), many, 80)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert found.count() == 300
