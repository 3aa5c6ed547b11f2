"""URL keys and scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without(url: Column, *patterns: str) -> Column:
    for p in patterns:
        url = F.regexp_replace(url, p, "")
    return url


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def key_page(url: Column) -> Column:
    """No scheme, www., query, fragment, closing slash or index.html; lower case."""
    return _without(F.lower(_without(url, r"[?#].*$")), r"^https?://", r"^www\.", r"/index\.html$", r"/+$")


def key_host_path(url: Column) -> Column:
    """Host and path without index.html or index.php and the closing slash."""
    return F.concat(host(url), _without(path(url), r"/index\.(?:html|php)$", r"/+$"))


def key_with_query(url: Column) -> Column:
    """Host without www., path without closing slash, and the query."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.concat(_without(host(url), r"^www\."), _without(path(url), r"/+$"), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def clean(url: Column) -> Column:
    """Scheme, lower-case host and path ("/" if empty); parameters, query and fragment dropped."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    p = _without(path(url), r";.*$")
    return F.concat(scheme, F.lit("://"), host(url), F.when(p == "", "/").otherwise(p))


def in_scope(url: Column, prefixes: list[str], exclude: str = r"(?i)\.(?:png|jpe?g|gif|svg|css|js|zip|gz|mp4)$|/(?:login|search|tag|feed)(?:/|$)") -> Column:
    """Under one of the prefixes (any scheme), without an excluded ending or part."""
    bare = _without(url, r"^[A-Za-z][A-Za-z0-9+.-]*://")
    under = F.lit(False)
    for p in prefixes:
        under = under | bare.startswith(p)
    return under & ~F.coalesce(path(url).rlike(exclude), F.lit(False))


#: Scheme, authority, path, query and fragment of a URL or of a reference to one.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def without_dots(path: Column) -> Column:
    """The path with "." dropped and ".." taking the segment before it away, by a fold over its segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    empty = F.array().cast("array<string>")
    # the empty segment before the first slash stays
    back = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(done)
    done = F.aggregate(segments, empty, lambda acc, s: F.when(s == "..", back(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(done, F.lit(""))).otherwise(done), "/")


def resolved(base: Column, link: Column) -> Column:
    """The absolute URL of a reference found at base, without its fragment; null for null.

    As RFC 3986 has it, but that references which name a host keep their dots, and empty segments within a relative
    path go.
    """
    part = lambda text, i: F.regexp_extract(text, PARTS, i)
    ref = F.regexp_replace(F.trim(link), "#.*$", "")
    scheme, authority, path = (part(ref, i) for i in (1, 2, 3))
    of_base = part(base, 3)
    folder = F.when((of_base == "") & (part(base, 2) != ""), "/").otherwise(F.regexp_replace(of_base, r"[^/]*$", ""))
    whole = F.when(path.startswith("/"), path).otherwise(F.regexp_replace(F.concat(folder, path), "(?<=.)/+(?=/)|(?<=^)/+(?=/)", ""))
    query = lambda text: F.when(text.rlike(r"^[^?#]*\?"), F.concat(F.lit("?"), part(text, 4))).otherwise("")
    head = F.concat(F.when(scheme != "", scheme).otherwise(part(base, 1)), F.lit("://"), F.when(authority != "", authority).otherwise(part(base, 2)))
    same = (path == "") & (authority == "")
    return F.when(scheme != "", ref).otherwise(
        F.concat(head, F.when(same, of_base).when(authority != "", path).otherwise(without_dots(whole)), F.when(same & ~ref.contains("?"), query(base)).otherwise(query(ref)))
    )
