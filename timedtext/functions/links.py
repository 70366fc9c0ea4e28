"""playback links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    """Query quoting: a space is +, and of the marks only _ . - ~ stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_link(source: Column, seconds: Column) -> Column:
    """A link to a time of a source; NULL for anything but http and https.

    Video pages of YouTube become one form without playlist and tracking parameters; for other hosts the parameter t is set,
    repeated parameters stand together, and the fragment goes.
    """
    part = lambda i: F.regexp_extract(source, _PARTS, i)
    scheme, netloc, path, query = part(1), part(2), part(3), part(4)
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), ":[0-9]*$", ""))
    t = F.greatest(seconds.cast("bigint"), F.lit(0)).cast("string")
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.locate("=", p) > 0, _decode(p.substr(F.locate("=", p) + 1, F.length(p)))).otherwise(F.lit("")).alias("v")),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p.k))
    video = F.get(F.filter(pairs, lambda p: (p.k == "v") & (p.v != "")), F.lit(0)).v
    tube = (host == "youtube.com") | host.endswith(".youtube.com")
    short = F.regexp_extract(path, "^/(?:shorts|embed|live)/([^/]*)", 1)
    identity = F.when(host == "youtu.be", F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")[0]).when(tube & (F.regexp_replace(path, "/+$", "") == "/watch"), video).when(tube & (short != ""), short)
    others = F.transform(keys, lambda k: F.when(k == "t", F.concat(F.lit("t="), t)).otherwise(F.array_join(F.transform(F.filter(pairs, lambda p: p.k == k), lambda p: F.concat(_encode(k), F.lit("="), _encode(p.v))), "&")))
    with_t = F.when(F.array_contains(keys, "t"), others).otherwise(F.array_append(others, F.concat(F.lit("t="), t)))
    plain = F.concat(scheme, F.lit("://"), netloc, path, F.lit("?"), F.array_join(with_t, "&"))
    ok = F.lower(scheme).isin("http", "https") & (host != "")
    return F.when(ok & (identity != ""), F.concat(F.lit("https://www.youtube.com/watch?v="), _encode(identity), F.lit("&t="), t)).when(ok, plain)
