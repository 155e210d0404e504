"""URL Column expressions (C1 guess part, C2 hostname, C15 levels, B10 resolve).

All are Catalyst regular expressions, so they stay inside whole-stage code
generation. A URL splits as ``scheme ':' ['//' authority] path ['?' query] ['#' fragment]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
# ASCII case folding used by case-insensitive URL keys.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _part(u: Column, i: int) -> Column:
    return F.regexp_extract(u, URL_RE, i)


def is_url(u: Column) -> Column:
    return u.rlike(URL_RE) & (F.length(_part(u, 3)) > 0)


def scheme(u: Column) -> Column:
    return F.lower(_part(u, 1))


def authority(u: Column) -> Column:
    return _part(u, 3)


def hostname(u: Column) -> Column:
    """Host without user info and port, letter case kept; NULL when not a URL."""
    host = F.regexp_extract(authority(u), r"^(?:[^@]*@)?([^:]*)", 1)
    return F.when(is_url(u), host)


def path(u: Column) -> Column:
    return _part(u, 4)


def url_key(u: Column) -> Column:
    """Case-insensitive identity: ASCII letters folded only (not all of Unicode)."""
    return F.translate(u, UPPER, LOWER)


def canonical_guess(u: Column) -> Column:
    """C1 steps 2-3: drop one trailing '/' of the path, and the fragment unless it holds '/'."""
    frag = _part(u, 6)
    head = F.concat(scheme(u), F.lit(":"), _part(u, 2), F.regexp_replace(path(u), "/$", ""),
                    _part(u, 5))
    keep = F.when(frag.contains("/"), frag).otherwise(F.lit(""))
    return F.when(is_url(u), F.concat(head, keep))


def origin(u: Column) -> Column:
    return F.concat(scheme(u), F.lit("://"), authority(u))


def levels(u: Column) -> Column:
    """C15 breadcrumbs: array<struct<url,text>>: origin, then each non-blank path segment."""
    segs = F.filter(F.split(path(u), "/"), lambda s: F.trim(s) != "")
    o = origin(u)
    crumbs = F.transform(segs, lambda s, i: F.struct(
        F.concat(o, F.lit("/"), F.array_join(F.slice(segs, 1, i + 1), "/")).alias("url"),
        s.alias("text")))
    first = F.array(F.struct(o.alias("url"), authority(u).alias("text")))
    return F.when(is_url(u), F.concat(first, crumbs))


def without_dots(u: Column) -> Column:
    """A URL whose path has its `.` and `..` segments resolved; any other string unchanged."""
    segs = F.split(path(u), "/")
    # the first segment of an absolute path is empty and is never left by '..'
    empty = F.array().cast("array<string>")
    kept = F.aggregate(segs, empty, lambda acc, s: F.when(s == ".", acc).when(
        s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)).otherwise(
        F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    tail = F.when((last == ".") | (last == ".."), F.lit("/")).otherwise(F.lit(""))
    new = F.concat(_part(u, 1), F.lit(":"), _part(u, 2), F.array_join(kept, "/"), tail, _part(u, 5), _part(u, 6))
    dotted = path(u).rlike(r"(^|/)\.\.?(/|$)")
    return F.when(is_url(u) & dotted, new).otherwise(u)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` against ``base``, dot segments removed."""
    base_nofrag = F.regexp_replace(base, "#.*$", "")
    base_noq = F.regexp_replace(base_nofrag, r"\?.*$", "")
    base_dir = F.regexp_replace(base_noq, "[^/]*$", "")
    return without_dots(
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin(base), ref))
        .when(ref.startswith("#"), F.concat(base_nofrag, ref))
        .when(ref.startswith("?"), F.concat(base_noq, ref))
        .when(ref == "", base_nofrag)
        .otherwise(F.concat(base_dir, ref)))
