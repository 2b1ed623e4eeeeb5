"""Link recognition (inventory I14-I16)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundalike.functions.text import nonempty, once, strip
from soundalike.functions.vectors import ColumnOrName, col

MAX_URL_LENGTH = 2048

# Platform -> pattern searched anywhere in the link, in order.
PLATFORMS = {
    "youtube": r"youtube\.com|youtu\.be",
    "soundcloud": r"soundcloud\.com|on\.soundcloud\.com",
    "spotify": r"open\.spotify\.com/track",
    "apple_music": r"music\.apple\.com/.+/(album|song)",
    "deezer": r"deezer\.com|link\.deezer\.com",
}
# Hosts and patterns of track links.
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")
VIDEO_ID = r"(?:v=|youtu\.be/|shorts/)([a-zA-Z0-9_-]{11})"
SPOTIFY_TRACK = r"(?U)^https?://open\.spotify\.com/(?:intl-\w+/)?track/([a-zA-Z0-9]+)"
SOUNDCLOUD_TRACK = r"(?U)^https?://(?:www\.)?soundcloud\.com/([\w-]+/[\w-]+)"
SOUNDCLOUD_SHORT = r"(?U)^https?://on\.soundcloud\.com/\w+"
APPLE_SONG = r"(?U)^https?://music\.apple\.com/\w+/song/[\w-]+/(\d+)"
APPLE_ALBUM = r"(?U)^https?://music\.apple\.com/\w+/album/[\w-]+/\d+"
DEEZER_TRACK = r"(?U)^https?://(?:www\.)?deezer\.com/(?:\w{2}/)?track/(\d+)"
DEEZER_SHARE = r"(?U)^https?://(?:link\.)?deezer\.(?:com|page\.link)/\S+"


def detect_platform(url: ColumnOrName) -> Column:
    """I14."""
    chain = None
    for name, pattern in PLATFORMS.items():
        hit = col(url).rlike(pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def url_host(url: ColumnOrName) -> Column:
    """Lower-case host without credentials and port; NULL where there is none."""
    return nonempty(F.lower(F.regexp_extract(
        strip(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)", 1)))


def host_allowed(url: ColumnOrName, hosts: Iterable[str]) -> Column:
    """I16: http(s) only; the host equals an entry or is a subdomain of one."""
    host = url_host(url)
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (host == h) | host.endswith(f".{h}")
    return F.coalesce(strip(url).rlike(r"(?i)^https?://") & hit, F.lit(False))


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return nonempty(F.regexp_extract(c, pattern, group))


def video_id(url: ColumnOrName) -> Column:
    found = _group(col(url), VIDEO_ID)
    return F.when(url_host(url).isin(*VIDEO_HOSTS), found)


def spotify_id(url: ColumnOrName) -> Column:
    return _group(strip(url), SPOTIFY_TRACK)


def soundcloud_id(url: ColumnOrName) -> Column:
    """``artist/track``; ``short`` for a link that still has to be resolved."""
    u = strip(url)
    return F.coalesce(_group(u, SOUNDCLOUD_TRACK), F.when(u.rlike(SOUNDCLOUD_SHORT), "short"))


def apple_id(url: ColumnOrName) -> Column:
    u = strip(url)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    item = _group(query, r"(?:^|&)i=([^&]+)")
    album = F.when(u.rlike(APPLE_ALBUM) & item.rlike(r"^\d+$"), item)
    return F.when(F.length(u) <= MAX_URL_LENGTH, F.coalesce(_group(u, APPLE_SONG), album))


def deezer_id(url: ColumnOrName) -> Column:
    """Track id; ``share`` for a link that still has to be resolved."""
    u = strip(url)
    return F.coalesce(_group(u, DEEZER_TRACK), F.when(u.rlike(DEEZER_SHARE), "share"))


def link_id(url: ColumnOrName) -> Column:
    """Track id of a supported link, NULL where it is not a valid track link."""
    def found(u: Column) -> Column:
        platform = detect_platform(u)
        return F.when(F.length(u) <= MAX_URL_LENGTH, F.when(platform == "youtube", video_id(u))
                      .when(platform == "spotify", spotify_id(u))
                      .when(platform == "soundcloud", soundcloud_id(u))
                      .when(platform == "apple_music", apple_id(u))
                      .when(platform == "deezer", deezer_id(u)))

    return once(col(url), found)
