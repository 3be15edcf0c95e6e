"""URL functions as column expressions.

A URL is taken apart by one pattern; what it doesn't match is no URL and stays as it is, or gets the function's default.
Nulls give null.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, authority, path, query and fragment.
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
TRACKING = r"^(utm_.*|fbclid|gclid|msclkid|ref|ref_src|mc_.*)$"


def contains_any(text: Column, needles) -> Column:
    """Whether a text holds one of some substrings."""
    return functools.reduce(operator.or_, (F.contains(text, F.lit(n)) for n in needles), F.lit(False))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def is_url(url: Column) -> Column:
    """Whether a text is an absolute URL with a host."""
    return url.rlike(URL) & (_part(url, 2) != "")


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    """The path, ``/`` if it is empty; null if the text is no URL."""
    found = _part(url, 3)
    return F.when(is_url(url), F.when(found == "", "/").otherwise(found))


def bare_host(url: Column) -> Column:
    """The host without ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def canonical(url: Column) -> Column:
    """The URL for comparison: no fragment, tracking parameters, default port or trailing slashes; scheme and host in lower case."""
    scheme = F.lower(_part(url, 1))
    authority = F.lower(_part(url, 2))
    authority = F.when(scheme == "http", F.regexp_replace(authority, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(authority, r":(443)?$", "")).otherwise(authority)
    trimmed = F.regexp_replace(_part(url, 3), r"/+$", "")
    whole = F.when(trimmed == "", "/").otherwise(trimmed)
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).rlike(TRACKING))
    pairs = F.transform(pairs, lambda p: F.replace(F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))), F.lit("+"), F.lit("%20")))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(is_url(url), F.concat(scheme, F.lit("://"), authority, whole, query)).otherwise(url)


def slug(url: Column) -> Column:
    """A file name for a page, ``home`` for the root, at most 80 characters."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(path(url), F.lit("/")), r"[^A-Za-z0-9_-]", "-"), "-+", "-")
    flat = F.regexp_replace(flat, r"^-|-$", "")
    return F.when(url.isNull(), None).when(flat == "", "home").otherwise(F.left(flat, F.lit(80)))


def host_slug(url: Column) -> Column:
    """A folder name for a site."""
    flat = F.regexp_replace(F.regexp_replace(bare_host(url), r"[^A-Za-z0-9-]", "_"), "_+", "_")
    flat = F.regexp_replace(flat, r"^_|_$", "")
    return F.when(url.isNull(), None).when(flat == "", "site").otherwise(flat)


def priority(url: Column) -> Column:
    """0 home, 1 contact, 2 about, 3 legal, 100 others, 200 accounts and the like."""
    p = F.lower(path(url))
    late = ("/account/", "/cart", "/checkout", "/login", "/signup", "/register", "/password", "/forgot", "/sign-in", "/sign-up", "/api/")
    return (
        F.when(p.isNull(), 100).when(p == "/", 0).when(contains_any(p, ("/contact", "/kontakt")) | p.endswith("/get-in-touch"), 1).when(F.contains(p, F.lit("/about")), 2)
        .when(contains_any(p, ("/imprint", "/impressum", "/legal", "/privacy", "/terms")), 3).when(contains_any(p, late) | p.startswith("/search"), 200).otherwise(100)
    )


def allowed(url: Column, excludes=(), includes=()) -> Column:
    """Whether a URL holds no excluded substring and, if there are included ones, one of those."""
    return ~contains_any(url, excludes) & (contains_any(url, includes) if includes else F.lit(True))


def disallowed(url: Column, rules: Column) -> Column:
    """Whether one of the robots rules (an array) covers a URL: ``/`` all, a trailing ``$`` the exact path, else a prefix."""
    p = path(url)
    hit = F.exists(rules, lambda r: F.when(r == "/", True).when(r.endswith("$"), p == F.regexp_replace(r, r"\$$", "")).otherwise(F.startswith(p, r)))
    return F.coalesce(is_url(url) & hit, F.lit(False))


def image_extension(url: Column) -> Column:
    """The file extension of an image URL, by the first known one it holds; ``jpg`` otherwise."""
    low = F.lower(url)
    kinds = (("svg", "svg"), ("png", "png"), ("jpeg", "jpg"), ("jpg", "jpg"), ("webp", "webp"), ("gif", "gif"), ("avif", "avif"), ("bmp", "bmp"), ("ico", "ico"))
    return F.coalesce(*(F.when(F.contains(low, F.lit("." + k)), v) for k, v in kinds), F.lit("jpg"))


def content_type_extension(kind: Column) -> Column:
    """The file extension of an image content type, else null."""
    low = F.lower(kind)
    kinds = (("jpeg", "jpg"), ("jpg", "jpg"), ("png", "png"), ("webp", "webp"), ("svg", "svg"), ("gif", "gif"), ("avif", "avif"), ("x-icon", "ico"), ("vnd.microsoft.icon", "ico"), ("bmp", "bmp"))
    return F.coalesce(*(F.when(F.contains(low, F.lit("image/" + k)), v) for k, v in kinds))


def asset_path(url: Column, folder: str = "images") -> Column:
    """Where a downloaded image is kept: the start of its URL's hash; null for trackers."""
    from pagemill.functions.tables import TRACKERS

    name = F.concat(F.lit(folder + "/"), F.left(F.sha2(url, 256), F.lit(16)), F.lit("."), image_extension(url))
    return F.when(~contains_any(F.lower(url), TRACKERS), name)
