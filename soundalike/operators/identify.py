"""Resolving free text and links to catalogue songs (inventory F9, J11, B10).

The reference behaviour is a substring search, which as a join is a theta-join.
Here it is an equi-join on n-grams: a request asks for its rarest n-gram, the
catalogue offers every n-gram of its titles (or artists), and the pairs that meet
are verified.  Requests and catalogue rows are first reduced to distinct names, so
a name shared by a third of all rows is one row at the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundalike.functions import links, text
from soundalike.session import cut

GRAM = 3


def _grams(c: Column, n: int | Column) -> Column:
    """Distinct character n-grams."""
    count = F.length(c) - n + 1
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(c, i, n)))


def _all_grams(c: Column) -> Column:
    """Every distinct gram of length 1 to ``GRAM`` (short requests ask for short grams)."""
    parts = [F.when(F.length(c) >= n, _grams(c, F.lit(n))).otherwise(F.array().cast("array<string>"))
             for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*parts))


def _containing(needles: DataFrame, haystack: DataFrame) -> DataFrame:
    """Pairs (needle, hay) where the distinct string ``hay`` contains ``needle``.

    Both inputs have one column of distinct, non-empty, lower-case strings.
    """
    offered = haystack.select("hay", F.explode(_all_grams(F.col("hay"))).alias("gram"))
    asked = needles.select("needle", F.explode(
        _grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    wanted = asked.select("gram").distinct()
    offered = offered.join(wanted, "gram", "left_semi")
    freq = offered.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram nobody offers decides the matter at once: nothing contains the needle.
    rarest = (asked.join(freq, "gram", "left").groupBy("needle")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
              .where(F.col("g.n") > 0).select("needle", F.col("g.gram").alias("gram")))
    return (rarest.join(offered, "gram").where(F.col("hay").contains(F.col("needle")))
            .select("needle", "hay"))


def _both_contained(asked: DataFrame, hits: DataFrame, artist_hits: DataFrame, pairs: DataFrame
                    ) -> DataFrame:
    """Lowest id per (qt, qa) among songs whose title and artist contain them.

    Two exact routes, chosen per request by the rows they would touch: over all
    artists of the matching titles, or over the matching titles and matching
    artists.  So neither a title nor an artist with a large share of the rows is
    paired with everything.
    """
    width = pairs.groupBy("lt").agg(F.count("*").alias("n"))
    t_cost = hits.join(width, "lt").groupBy("qt").agg(
        F.sum("n").alias("rows"), F.count("*").alias("titles"))
    a_cost = artist_hits.groupBy("qa").agg(F.count("*").alias("artists"))
    routed = cut(asked.join(t_cost, "qt").join(a_cost, "qa").select(
        "qt", "qa", (F.col("rows") <= F.col("titles") * F.col("artists")).alias("by_title")))
    by_title = (routed.where("by_title").join(hits, "qt").join(pairs, "lt")
                .where(F.col("la").contains(F.col("qa"))))
    by_both = (routed.where("NOT by_title").join(hits, "qt").join(artist_hits, "qa")
               .join(pairs, ["lt", "la"]))
    cols = ("qt", "qa", "id")
    return (by_title.select(*cols).unionByName(by_both.select(*cols))
            .groupBy("qt", "qa").agg(F.min("id").alias("id1")))


def _names(songs: DataFrame) -> DataFrame:
    return songs.select("id", F.lower("title").alias("lt"), F.lower("artist").alias("la"), "artist")


def identify(requests: DataFrame, songs: DataFrame, *, clean: bool = True,
             title_pool: int | None = None) -> DataFrame:
    """The catalogue song of every request, or none.

    ``requests``: ``request_id, artist, title`` (parsed).  Tiers: (1) artist and
    title both contained; (2) title contained, of the first ``title_pool`` such songs
    (all without it) the first whose artist matches, or the first of all when the
    request names no artist; (3) artist contained, only when the request has no title.  First means
    lowest id.  Result: ``request_id, song_id, tier, matched, needs_ingest``.
    """
    req = requests.select(
        "request_id",
        F.lower(text.clean_title("title") if clean else F.col("title")).alias("qt"),
        (text.clean_artist("artist") if clean else F.lower("artist")).alias("qa"))
    req = req.withColumn("qt", F.coalesce("qt", F.lit(""))).withColumn(
        "qa", F.coalesce("qa", F.lit("")))
    asked = req.select("qt", "qa").distinct()
    songs_ = _names(songs)

    # Titles: distinct needle x distinct title, then the songs of these titles.
    titles = songs_.where(F.col("lt") != "").select(F.col("lt").alias("hay")).distinct()
    needles = asked.where("qt != ''").select(F.col("qt").alias("needle")).distinct()
    hits = _containing(needles, titles).withColumnsRenamed({"needle": "qt", "hay": "lt"})

    # Tier 1: lowest id per (title, artist) is enough, since the test sees only names.
    hits = cut(hits)
    pairs = songs_.groupBy("lt", "la").agg(F.min("id").alias("id"))
    artists = songs_.where(F.col("la") != "").select(F.col("la").alias("hay")).distinct()
    who = asked.where("qa != ''").select(F.col("qa").alias("needle")).distinct()
    artist_hits = cut(_containing(who, artists).withColumnsRenamed({"needle": "qa", "hay": "la"}))
    tier1 = _both_contained(asked.where("qt != '' AND qa != ''"), hits, artist_hits, pairs)

    # Tier 2: the test sees only names, so without a pool the lowest id per (title, artist) is enough.
    if title_pool is None:
        firsts = songs_.groupBy("lt", "artist").agg(F.min("id").alias("id"))
        pool = hits.join(firsts, "lt")
    else:
        per_title = Window.partitionBy("lt").orderBy("id")
        firsts = (songs_.withColumn("n", F.row_number().over(per_title))
                  .where(F.col("n") <= title_pool).drop("n"))
        per_needle = Window.partitionBy("qt").orderBy("id")
        pool = (hits.join(firsts, "lt").withColumn("n", F.row_number().over(per_needle))
                .where(F.col("n") <= title_pool))
    fits = (F.col("qa") == "") | text.artists_match(
        text.clean_artist("qa"), text.clean_artist("artist"))
    tier2 = (asked.where("qt != ''").join(pool, "qt").where(fits)
             .groupBy("qt", "qa").agg(F.min("id").alias("id2")))

    # Tier 3: artist only.
    by_artist = songs_.groupBy("la").agg(F.min("id").alias("id3"))
    tier3 = (asked.where("qt = '' AND qa != ''").join(artist_hits, "qa").join(by_artist, "la")
             .groupBy("qt", "qa").agg(F.min("id3").alias("id3")))

    found = (asked.join(tier1, ["qt", "qa"], "left").join(tier2, ["qt", "qa"], "left")
             .join(tier3, ["qt", "qa"], "left"))
    found = found.select(
        "qt", "qa", F.coalesce("id1", "id2", "id3").alias("song_id"),
        F.when(F.col("id1").isNotNull(), 1).when(F.col("id2").isNotNull(), 2)
        .when(F.col("id3").isNotNull(), 3).alias("tier"))
    return req.join(found, ["qt", "qa"]).select(
        "request_id", "song_id", "tier", F.col("song_id").isNotNull().alias("matched"),
        (F.col("song_id").isNull() & (F.col("qt") != "") & (F.col("qa") != "")).alias(
            "needs_ingest"))


def parse_requests(requests: DataFrame) -> DataFrame:
    """Links and raw titles -> ``platform, link, artist, title``.

    ``requests``: ``request_id, url, raw_title, author``.  Video titles have their
    own heuristics; rows without a valid link get a NULL ``link``.
    """
    platform = links.detect_platform("url")
    parsed = F.when(platform == "youtube", text.parse_video_title("raw_title", "author")).otherwise(
        text.parse_title("raw_title", "author"))
    return (requests.withColumn("platform", platform).withColumn("link", links.link_id("url"))
            .withColumn("_p", parsed)
            .select("request_id", "platform", "link", F.col("_p.artist").alias("artist"),
                    F.col("_p.title").alias("title")))


def identify_links(requests: DataFrame, songs: DataFrame, **kw) -> DataFrame:
    """Parsed and resolved requests; only rows with a valid link are looked up."""
    parsed = parse_requests(requests)
    found = identify(parsed.where(F.col("link").isNotNull()), songs, **kw)
    return parsed.join(found, "request_id", "left").select(
        "request_id", "platform", "link", "artist", "title", "song_id", "tier",
        F.coalesce("matched", F.lit(False)).alias("matched"),
        F.coalesce("needs_ingest", F.lit(False)).alias("needs_ingest"))
