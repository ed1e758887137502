"""URL functions on text: no parser is asked, so a malformed URL stays what it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query parameters that only track.
TRACKERS = ["fbclid", "gclid", "yclid", "mc_cid", "mc_eid"]


def _tracks(item: Column) -> Column:
    key = F.lower(F.split_part(item, F.lit("="), F.lit(1)))
    return key.startswith("utm_") | key.isin(TRACKERS)


def canonical(c: Column) -> Column:
    """Scheme and host in lower case, tracking parameters and fragment gone, query sorted, no slash at the path's end."""
    url = clean(c)
    path = F.regexp_extract(url, PARTS, 3)
    path = F.when(path.isin("", "/"), "/").otherwise(F.rtrim(path, F.lit("/")))
    items = F.filter(F.split(F.regexp_extract(url, PARTS, 4), "&"), lambda x: (x != "") & ~_tracks(x))
    query = F.array_join(F.sort_array(F.transform(items, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))), "&")
    whole = F.concat(F.lower(F.regexp_extract(url, PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(url, PARTS, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(PARTS), whole).otherwise(F.rtrim(url, F.lit("/")))


def host(c: Column) -> Column:
    """The host in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(clean(c), PARTS, 2)), r"^www\.", "")


def in_domain(c: Column, *domains: str) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(c)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def redirect_target(c: Column) -> Column:
    """The URL that a redirect carries as a parameter, if any."""
    found = F.regexp_extract(clean(c), r"[?&](?:url|u|q|target|redirect|to)=(https?(?:%3A|:)[^&#]+)", 1)
    return F.when(found != "", F.try_url_decode(found)).otherwise(clean(c))
