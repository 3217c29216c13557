"""URL column functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# --- fixed: platform patterns, tried in this order
PLATFORM_PATTERNS = {
    "youtube": r"youtube\.com|youtu\.be",
    "tiktok": r"tiktok\.com",
    "twitter": r"twitter\.com|x\.com|t\.co",
    "instagram": r"instagram\.com",
    "twitch": r"twitch\.tv",
    "dailymotion": r"dailymotion\.com|dai\.ly",
    "vimeo": r"vimeo\.com",
    "reddit": r"reddit\.com|v\.redd\.it",
    "facebook": r"facebook\.com|fb\.watch",
    "bilibili": r"bilibili\.com|b23\.tv",
}
# --- fixed: handle pattern, key prefix and path words that are no handles
HANDLE_RULES = {
    "youtube": ("yt:", [r"youtube\.com/channel/([^/?]+)", r"youtube\.com/c/([^/?]+)", r"youtube\.com/@([^/?]+)",
                        r"youtube\.com/user/([^/?]+)"], []),
    "tiktok": ("tt:", [r"tiktok\.com/@([^/?]+)"], []),
    "twitter": ("tw:", [r"(?:twitter|x)\.com/([^/?]+)"], ["i", "home", "search", "explore"]),
    "instagram": ("ig:", [r"instagram\.com/([^/?]+)"], ["p", "reel", "stories", "explore"]),
    "twitch": ("twitch:", [r"twitch\.tv/([^/?]+)"], ["directory", "videos"]),
}
# --- fixed: address used when the source gives only an id
DEFAULT_URLS = {
    "tiktok": "https://www.tiktok.com/video/",
    "twitter": "https://twitter.com/i/status/",
    "instagram": "https://www.instagram.com/reel/",
    "twitch": "https://www.twitch.tv/videos/",
    "vimeo": "https://vimeo.com/",
}


def detect_platform(url: Column | str) -> Column:
    low = F.lower(col(url))
    rules = list(PLATFORM_PATTERNS.items())
    out = F.when(low.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("other")


def channel_key(url: Column | str, platform: Column | str) -> Column:
    u, p = col(url), col(platform)
    found = []
    for name, (prefix, patterns, reserved) in HANDLE_RULES.items():
        for pattern in patterns:
            handle = F.nullif(F.regexp_extract(u, pattern, 1), F.lit(""))
            ok = (p == name) & handle.isNotNull()
            if reserved:
                ok = ok & ~handle.isin(reserved)
            found.append(F.when(ok, F.concat(F.lit(prefix), handle)))
    slug = F.nullif(F.regexp_extract(F.regexp_replace(u, "/+$", ""), r"([^/]*)$", 1), F.lit(""))
    return F.coalesce(*found, F.concat(p, F.lit(":"), slug))


def canonical_url(vid: Column | str, url: Column | str, platform: Column | str) -> Column:
    v, u, p = col(vid).cast("string"), F.coalesce(col(url), F.lit("")), col(platform)
    out = F.when(
        p == "youtube",
        F.when(F.contains(u, F.lit("shorts")), F.concat(F.lit("https://www.youtube.com/shorts/"), v))
        .otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), v)),
    )
    for name, stem in DEFAULT_URLS.items():
        out = out.when(p == name, F.when(u != "", u).otherwise(F.concat(F.lit(stem), v)))
    return out.otherwise(u)


def timecoded_url(url: Column | str, seconds: Column | str) -> Column:
    u, low, t = col(url), F.lower(col(url)), col(seconds).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), F.floor((t % 3600) / 60).cast("long"), t % 60
    mark = F.when(F.contains(u, F.lit("?")), "&t=").otherwise("?t=")
    hms = F.when(h > 0, F.format_string("%dh%dm%ds", h, m, s)).otherwise(F.format_string("%dm%ds", m, s))
    return (
        F.when(low.rlike(r"youtube\.com|youtu\.be"), F.concat(u, mark, t.cast("string"), F.lit("s")))
        .when(F.contains(low, F.lit("twitch.tv")), F.concat(u, mark, hms))
        .when(F.contains(low, F.lit("vimeo.com")), F.concat(u, F.lit("#t="), t.cast("string"), F.lit("s")))
        .otherwise(u)
    )


def url_job_type(url: Column | str) -> Column:
    low = F.lower(col(url))
    return F.when(low.rlike(r"playlist|list="), "playlist").when(low.rlike(r"/@|/c/|/channel/|/user/"), "channel").otherwise("video")


def domain(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(col(url), r"^https?://([^/?#:]+)", 1)), r"^www\.", "")
