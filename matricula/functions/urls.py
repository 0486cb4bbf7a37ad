"""URL parts, canonical forms, resolution and link classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matricula import fixed_values as V

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def _rstrip_slash(text: Column) -> Column:
    return F.regexp_replace(text, "/+$", "")


def last_segment(text: Column) -> Column:
    return F.regexp_extract(text, "([^/]*)$", 1)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash, query kept."""
    raw = path(url)
    clean = F.when(raw.isin("", "/"), F.lit("/")).otherwise(_rstrip_slash(raw))
    q = query(url)
    return F.concat(
        scheme(url),
        F.lit("://"),
        F.lower(netloc(url)),
        clean,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
    )


def homepage_url(url: Column) -> Column:
    """Catalog homepage with a scheme; null when blank."""
    bare = F.nullif(F.trim(url), F.lit(""))
    return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def _with_scheme(url: Column) -> Column:
    bare = F.lower(F.trim(url))
    return F.when(bare.contains("//"), bare).otherwise(F.concat(F.lit("https://"), bare))


def homepage_host(url: Column) -> Column:
    host = F.regexp_replace(netloc(_with_scheme(url)), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def homepage_key(url: Column) -> Column:
    """`host/path` without `www.`, for comparing homepages of two sources."""
    return F.concat(homepage_host(url), _rstrip_slash(path(_with_scheme(url))))


def registrable_domain(url: Column) -> Column:
    """Last two host labels, or three under a compound suffix."""
    host = F.regexp_replace(F.regexp_replace(homepage_host(url), "^.*@", ""), r":\d+$", "")
    last_two = F.substring_index(host, ".", -2)
    return F.when(
        last_two.isin(*V.COMPOUND_SUFFIXES), F.substring_index(host, ".", -3)
    ).otherwise(last_two)


def looks_edu(url: Column) -> Column:
    host = F.substring_index(
        F.regexp_replace(F.lower(F.trim(url)), "^https?://", ""), "/", 1
    )
    return host.rlike(r"(^|\.)edu$")


# ------------------------------------------------------------ resolution ----
def _remove_dots(text: Column) -> Column:
    parts = F.split(text, "/")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(walked, "/"), tail)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of `href` seen on page `base`."""
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    base_path = path(base)
    folder = F.concat(
        F.lit("/"), F.regexp_extract(base_path, r"(?s)^/?(.*/)?[^/]*$", 1)
    )
    target = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    suffix = F.substring(href, F.length(target) + 1, F.length(href))
    merged = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    merged = F.when(merged.rlike(r"(^|/)\.{1,2}(/|$)"), _remove_dots(merged)).otherwise(merged)
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .otherwise(F.concat(origin, merged, suffix))
    )


# --------------------------------------------------------- classification ---
def is_asset(url: Column) -> Column:
    p = F.lower(path(url))
    extensions = "|".join(e.replace(".", r"\.") for e in V.ASSET_EXTENSIONS)
    return p.rlike(f"(?:{extensions})$|" + "|".join(V.ASSET_PATH_HINTS))


def classify_link(href: Column, page_url: Column, text: Column, rel: Column) -> Column:
    """`pagination`, `profile` or `ignore`; the rules apply in this order."""
    same_path = _rstrip_slash(path(href)) == _rstrip_slash(path(page_url))
    keys = "|".join(V.PAGINATION_QUERY_KEYS)
    paged_query = query(href).rlike(f"(?i)(?:^|&)(?:{keys})=[^&]")
    lowered = F.lower(href)
    profile = None
    for pattern in V.PROFILE_PATTERNS:
        hit = lowered.contains(pattern)
        profile = hit if profile is None else profile | hit
    return (
        F.when(F.coalesce(F.lower(rel).rlike("next|prev"), F.lit(False)), "pagination")
        .when(same_path & (query(href) != query(page_url)) & paged_query, "pagination")
        .when(path(href).rlike(V.PAGINATION_PATH), "pagination")
        .when(F.trim(text).rlike(V.PAGINATION_TEXT), "pagination")
        .when(is_asset(href), "ignore")
        .when(profile, "profile")
        .otherwise("ignore")
    )


def is_directory_index(url: Column) -> Column:
    """A faculty/people/staff listing page, as opposed to a page under one."""
    p = F.lower(path(url))
    base = last_segment(_rstrip_slash(p))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return p.rlike("|".join(V.DIRECTORY_HINTS)) & (
        base.isin(*V.INDEX_BASENAMES) | stem.isin(*V.DIRECTORY_HINTS)
    )


def cluster_parent(url: Column) -> Column:
    """Parent folder of a possible profile page, null when it cannot be one."""
    p = path(url)
    usable = (p != "") & ~p.endswith("/") & F.lower(p).rlike("|".join(V.DIRECTORY_HINTS))
    parent = F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(
        usable, F.concat(scheme(url), F.lit("://"), netloc(url), parent, F.lit("/"))
    )


def candidate_urls(homepage: Column, paths: tuple[str, ...] = V.HEURISTIC_PATHS) -> Column:
    base = _rstrip_slash(homepage)
    return F.array(*[F.concat(base, F.lit(p)) for p in paths])
