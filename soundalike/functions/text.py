"""Title, artist, date and tag expressions (inventory I1-I13, I21, I23, I24)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundalike.functions.vectors import ColumnOrName, col

# Patterns of version and noise labels.
BRACKETED = r"(?U)\s*[\(\[].*?[\)\]]\s*"
VERSION_SUFFIX = (
    r"(?iU)\s*[-–—]\s*(?:radio edit|extended|remix|original mix|club mix|dub mix|"
    r"instrumental|acoustic|live|remaster(?:ed)?|slowed|sped up|mix cut|mixed|"
    r"feat\..*|ft\..*)$")
NOISE_LABEL = (
    r"(?iU)[\(\[]\s*(?:official\s+music\s+video|official\s+audio|official\s+video|"
    r"lyric\s+video|lyrics|visualizer|audio|video|hd|hq)\s*[\)\]]")
NOISE_BLOCK = (
    r"(?iU)\s*[\(\[](Official|Audio|Lyric|Music|HD|4K|Visualizer|Live|Remix|Explicit|Remaster)"
    r"[^\)\]]*[\)\]]")
VIDEO_SUFFIX = (
    r"(?iU)\s*\((?:official\s+(?:video|audio|music\s+video|lyric\s+video)|"
    r"lyrics?|audio|hd|4k|official|visualizer|live|remix|explicit)\)")
TOPIC_SUFFIX = r"(?iU)\s*-\s*Topic$"


def strip(c: ColumnOrName) -> Column:
    """Trim Unicode whitespace (``trim`` only drops spaces)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def nonempty(c: ColumnOrName) -> Column:
    """NULL for an empty string."""
    return F.nullif(col(c), F.lit(""))


def base_title(title: ColumnOrName) -> Column:
    """Title without bracketed parts and version suffix, lower case."""
    t = F.regexp_replace(col(title), BRACKETED, "")
    return F.lower(strip(F.regexp_replace(t, VERSION_SUFFIX, "")))


def clean_title(title: ColumnOrName) -> Column:
    """Drop noise labels, unify the spelling of ``feat.``."""
    t = F.regexp_replace(col(title), NOISE_LABEL, "")
    t = F.regexp_replace(t, r"(?iU)\bfeaturing\b", "feat.")
    return strip(F.regexp_replace(t, r"(?iU)\bft\.?\s+", "feat. "))


def strip_topic(name: ColumnOrName) -> Column:
    return strip(F.regexp_replace(col(name), TOPIC_SUFFIX, ""))


def clean_artist(name: ColumnOrName) -> Column:
    """I3."""
    return F.lower(strip_topic(name))


def artists_match(a: ColumnOrName, b: ColumnOrName) -> Column:
    """I4: equal, one contains the other, or a shared word of three or more letters."""
    x, y = col(a), col(b)

    def words(c: Column) -> Column:
        return F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) >= 3)

    return F.coalesce(
        (x != "") & (y != "")
        & (x.contains(y) | y.contains(x) | F.arrays_overlap(words(x), words(y))),
        F.lit(False))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated one time, however often ``use`` names it.

    Keeps expressions that branch on a cleaned string from being expanded branch by
    branch into one very large generated method.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(c: Column, sep: str) -> Column:
    return strip(F.substring_index(c, sep, 1))


def _after(c: Column, sep: str) -> Column:
    return strip(c.substr(F.instr(c, sep) + len(sep), F.length(c)))


def parse_title(title: ColumnOrName, author: ColumnOrName) -> Column:
    """struct(artist, title) from ``Artist - Title`` or a plain title."""
    raw = F.coalesce(col(title), F.lit(""))
    who = strip(F.coalesce(nonempty(author), F.lit("Unknown")))

    def parts(cleaned: Column) -> Column:
        split_up = cleaned.contains(" - ")
        return F.struct(
            F.when(split_up, _before(cleaned, " - ")).otherwise(who).alias("artist"),
            F.when(split_up, _after(cleaned, " - "))
            .otherwise(F.coalesce(nonempty(cleaned), raw)).alias("title"))

    return once(strip(F.regexp_replace(raw, NOISE_BLOCK, "")), parts)


def parse_video_title(title: ColumnOrName, author: ColumnOrName) -> Column:
    """struct(artist, title) from ``A - T``, ``A | T`` or ``T by A``."""
    who = strip_topic(F.coalesce(col(author), F.lit("")))
    by = r"(?iU)^(.+?)\s+by\s+(.+)$"

    def parts(t: Column) -> Column:
        dash, bar = t.contains(" - "), t.contains(" | ")
        artist = (F.when(dash, _before(t, " - ")).when(bar, _before(t, " | "))
                  .when(t.rlike(by), strip(F.regexp_extract(t, by, 2))).otherwise(who))
        name = (F.when(dash, _after(t, " - ")).when(bar, _after(t, " | "))
                .when(t.rlike(by), strip(F.regexp_extract(t, by, 1))).otherwise(t))
        return F.struct(artist.alias("artist"), name.alias("title"))

    return once(strip(F.regexp_replace(F.coalesce(col(title), F.lit("")), VIDEO_SUFFIX, "")), parts)


def parse_duration(text: ColumnOrName) -> Column:
    """``MM:SS`` or ``HH:MM:SS`` to seconds, NULL otherwise."""
    numbers = F.transform(F.split(strip(text), ":"), lambda p: F.when(
        strip(p).rlike(r"^\d+$"), strip(p).cast("double")))

    def seconds(n: Column) -> Column:
        at = lambda i: F.get(n, F.lit(i))
        return (F.when(F.size(n) == 2, at(0) * 60 + at(1))
                .when(F.size(n) == 3, at(0) * 3600 + at(1) * 60 + at(2)))

    return once(numbers, seconds)


def parse_year(text: ColumnOrName) -> Column:
    """I8: first four-digit token strictly between 1900 and 2100."""
    tokens = F.split(F.translate(col(text), "/-", "  "), r"(?U)\s+")
    years = F.filter(
        tokens,
        lambda w: w.rlike(r"^[0-9]{4}$") & (w > F.lit("1900")) & (w < F.lit("2100")))
    return F.get(years, F.lit(0)).cast("int")


def release_year(recorded: ColumnOrName, created: ColumnOrName) -> Column:
    """Year of the recording date, or of the creation date where that is blank."""
    return parse_year(F.coalesce(nonempty(strip(recorded)), strip(created)))


def genre_titles(literal: ColumnOrName) -> Column:
    """Titles in a list-of-records literal, in order; malformed text gives none."""
    c = strip(literal)
    pattern = (r"""['"]genre_title['"]\s*:\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")""")
    single = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    double = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    titles = F.zip_with(single, double, lambda s, d: F.when(s != "", s).otherwise(d))
    well_formed = c.rlike(r"(?s)^\[.*\]$")
    return F.when(F.coalesce(well_formed, F.lit(False)), F.filter(titles, lambda x: x != "")
                  ).otherwise(F.array().cast("array<string>"))


def lookup(mapping: Mapping, key: Column) -> Column:
    """Value of a small fixed mapping, NULL where the key is absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def first_mapped_tag(tags: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Genre of the first tag (in the item's own order) that has one."""
    return F.get(F.filter(F.transform(col(tags), lambda t: lookup(mapping, t)),
                          lambda g: g.isNotNull()), F.lit(0))


def has_any_tag(tags: ColumnOrName, wanted: Iterable[str]) -> Column:
    return F.arrays_overlap(col(tags), F.array(*[F.lit(w) for w in wanted]))


# Numeric genre id of the external catalogue -> label.
GENRE_LABELS = {
    106: "Electro",
    113: "Dance",
    85: "Alternative",
    116: "Hip Hop",
    129: "Jazz",
    165: "R&B",
    169: "Soul / Funk",
    464: "Metal",
    466: "Folk",
    152: "Klassik",
    130: "Acoustic",
    98: "Reggae",
    186: "Latino",
    2: "Country",
    173: "Soundtrack",
    132: "World",
    197: "World",
}
# Genre ids that count as electronic, and the coarse labels for them.
ELECTRONIC_GENRE_IDS = (106, 113, 85)
COARSE_GENRE_LABELS = {106: "Electronic", 113: "Electronic", 85: "Electronic"}
FALLBACK_GENRE = "Electronic"

# Tag of the open-licence catalogue -> genre.
TAG_GENRES = {
    "techno": "Techno",
    "house": "House",
    "deephouse": "House",
    "trance": "Trance",
    "drumnbass": "Drum & Bass",
    "dubstep": "Dubstep",
    "idm": "IDM",
    "minimal": "Minimal Electronic",
    "breakbeat": "Breakbeat",
    "downtempo": "Downtempo",
    "chillout": "Chill-out",
    "ambient": "Ambient",
    "darkambient": "Ambient",
    "dance": "Dance",
    "club": "Dance",
    "eurodance": "Dance",
    "edm": "Electronic",
    "electronica": "Electronic",
    "electropop": "Electronic",
    "synthpop": "Electronic",
    "darkwave": "Electronic",
    "industrial": "Electronic",
    "electronic": "Electronic",
}


def genre_label(genre_id: ColumnOrName, labels: Mapping[int, str] | None = None,
                fallback: str = FALLBACK_GENRE) -> Column:
    """I12."""
    return F.coalesce(
        lookup(labels or GENRE_LABELS, col(genre_id).cast("int")), F.lit(fallback))


def album_genre(genre_id: ColumnOrName, genres: ColumnOrName,
                labels: Mapping[int, str] | None = None,
                fallback: str = FALLBACK_GENRE) -> Column:
    """Label of the album genre, else the first listed genre with a label or name.

    ``genres`` is ``array<struct<id,name>>``.
    """
    table = labels or GENRE_LABELS
    listed = F.filter(
        F.transform(col(genres), lambda g: F.coalesce(
            lookup(table, g["id"].cast("int")), nonempty(g["name"]))),
        lambda x: x.isNotNull())
    return F.coalesce(lookup(table, col(genre_id).cast("int")),
                      F.get(listed, F.lit(0)), F.lit(fallback))


def pseudonym(ip: ColumnOrName) -> Column:
    """First 16 hex digits of the SHA-256 of an address."""
    return F.substring(F.sha2(F.coalesce(col(ip), F.lit("unknown")), 256), 1, 16)


def artist_credit(credits: ColumnOrName) -> Column:
    """``array<struct<name,joinphrase>>`` to one display name."""
    named = F.filter(col(credits), lambda c: F.coalesce(c["name"], F.lit("")) != "")
    return strip(F.array_join(F.transform(
        named, lambda c: F.concat(c["name"], F.coalesce(c["joinphrase"], F.lit("")))), ""))


def first_release(releases: ColumnOrName) -> Column:
    """Title of the first release, empty where there is none."""
    return F.coalesce(F.get(col(releases), F.lit(0))["title"], F.lit(""))


def first_recording(results: ColumnOrName) -> Column:
    """Id of the first recording of the first result that has recordings."""
    with_any = F.filter(col(results), lambda r: F.coalesce(F.size(r["recordings"]), F.lit(0)) > 0)
    return F.get(F.get(with_any, F.lit(0))["recordings"], F.lit(0))["id"]
