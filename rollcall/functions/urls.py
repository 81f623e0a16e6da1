"""URLs and hosts, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that never change what is served, and paths that hold no directories.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga", "ref", "referrer"]
EXCLUDED = [
    r"/(calendar|events?|event-calendar|ical)(/|$|\?)",
    r"/(news|press|blog|announcements?|archives?|stories)(/|$|\?)",
    r"/(athletics/schedule|schedules?|scores|standings)(/|$|\?)",
    r"/(tag|tags|category|categories|author)(/|$)",
    r"/(login|signin|sign-in|account|register|portal|sso|auth)(/|$|\?)",
    r"/(search)(/|$)\?.*\b(date|month|year)=",
    r"/(menus?|lunch-menu|nutrition-menu)(/|$)",
    r"/(gallery|photos?|media/photos)(/|$)",
    r"/(cart|checkout|donate|store|shop)(/|$)",
    r"\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|jpg|jpeg|png|gif|svg|mp4|mp3|ics|rss|xml)(\?|$)",
    r"[?&](month|year|cal_date|date)=\d",
    r"/(wp-admin|wp-login|xmlrpc\.php)(/|$)",
]
SECOND_LEVEL = ["co", "ac", "gov", "edu", "org", "net", "com"]

AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"


def full_host(url: Column) -> Column:
    """Lower case, without user info, port and trailing dots; null where a URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, AUTHORITY, 2)), r"\.+$", "")
    return F.nullif(host, F.lit(""))


def host_of(url: Column) -> Column:
    """The host without a leading www., null where a URL has none."""
    return F.regexp_replace(full_host(url), r"^www\.", "")


def canonical(url: Column) -> Column:
    """The form in which equal pages are equal: http or https only (else null), lower scheme and host, no user info,
    default port, fragment or tracking parameters, the others in stable order by name, single slashes and none at the
    end of a path."""
    url = F.trim(url)
    scheme, port = F.lower(F.regexp_extract(url, AUTHORITY, 1)), F.regexp_extract(url, AUTHORITY, 3)
    default = F.when(scheme == "https", "443").otherwise("80")
    path = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 4), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    asked = F.filter(F.split(F.substring(F.regexp_extract(url, AUTHORITY, 5), 2, 1 << 30), "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    left = F.filter(asked, lambda p: ~F.lower(name(p)).isin(TRACKING))
    placed = F.array_sort(F.transform(left, lambda p, k: F.struct(name(p).alias("name"), k.alias("at"), p.alias("own"))))
    query = F.array_join(F.transform(placed, lambda x: F.when(F.contains(x.own, F.lit("=")), x.own).otherwise(F.concat(x.own, F.lit("=")))), "&")
    made = F.concat(scheme, F.lit("://"), full_host(url), F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https"), made)


def resolved(href: Column, base: Column) -> Column:
    """The canonical form of a link on a page: whole URLs, //host, /path, ?query and paths beside the page's own; null
    for mail, phone, script and fragment links. Dots in paths are followed."""
    href = F.trim(href)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    target = F.regexp_extract(href, "^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(\?[^#]*)?", 1)
    joined = F.when(target.startswith("/"), target).when(target == "", path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), target))
    parts = F.slice(F.split(joined, "/"), 2, 1 << 20)
    walk = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done).when(p == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, p)),
    )
    local = F.concat(origin, F.lit("/"), F.array_join(walk, "/"), rest)
    whole = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href)).otherwise(local)
    return F.when((href != "") & ~href.rlike("(?i)^(?:mailto:|tel:|javascript:|#)"), canonical(whole))


def registrable(host: Column, labels: list[str] = []) -> Column:  # noqa: B006
    """The part that two hosts of one site share. Under .us the labels mark <site>.<label>.<state>.us and
    <label>.<place>.<state>.us."""
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    parts = F.split(host, r"\.")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
    from_end = lambda k: F.try_element_at(parts, F.lit(-k))
    out = F.when(n <= 2, host)
    if labels:
        state = lambda c: c.rlike("^[a-z]{2}$")
        us = from_end(1) == "us"
        out = out.when(us & from_end(3).isin(labels) & state(from_end(2)), last(4))
        out = out.when(us & from_end(4).isin(labels) & state(from_end(2)), last(4))
    return out.when(last(2).rlike(rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"), last(3)).otherwise(last(2))


def exclusion(url: Column) -> Column:
    """The number, from 0, of the first pattern that rules a URL out; null if none does."""
    out = F.when(F.lit(False), 0)
    for k, p in enumerate(EXCLUDED):
        out = out.when(url.rlike("(?i)" + p), k)
    return out


def directory_score(url: Column, hints: dict[str, float]) -> Column:
    """The greatest weight of the patterns that a URL meets; 0 where it is excluded."""
    best = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(url.rlike("(?i)" + p), w).otherwise(0.0) for p, w in hints.items()])
    return F.when(exclusion(url).isNotNull(), 0.0).otherwise(best)


def website_root(url: Column) -> Column:
    """Scheme and host with a slash."""
    return F.regexp_extract(canonical(url), "^([a-z]+://[^/]+/)", 1)


def in_scope(url: Column, website: Column) -> Column:
    """Whether a URL lies on a website's host and below its path."""
    a, b = canonical(url), canonical(website)
    root = F.regexp_replace(F.regexp_replace(b, r"\?.*$", ""), "/$", "")
    same = F.regexp_replace(a, "^https?://(?:www\\.)?", "")
    under = F.regexp_replace(root, "^https?://(?:www\\.)?", "")
    return F.coalesce((same == under) | same.startswith(F.concat(under, F.lit("/"))) | same.startswith(F.concat(under, F.lit("?"))), F.lit(False))


def published_website(c: Column) -> Column:
    """A website as a file states it: with a scheme, canonical; null for blanks and 'n/a'."""
    own = F.trim(c)
    own = F.when(~F.lower(own).isin("", "n/a", "na", "none", "null", "-"), own)
    return canonical(F.when(own.rlike("(?i)^https?://"), own).otherwise(F.concat(F.lit("http://"), own)))


def machine_reason(url: Column) -> Column:
    """Why a URL is no page for people: its scheme, an API's host or path, or a data format; null if it may be one."""
    path = F.lower(F.regexp_extract(url, AUTHORITY, 4))
    return (
        F.when(~F.coalesce(F.lower(url).rlike("^https?://[^/]"), F.lit(False)), "not_http")
        .when(full_host(url).rlike(r"^(?:api|graphql|data-api)\."), "api_host")
        .when(path.rlike(r"/(?:api|graphql|rest|odata|wp-json)(?:/|$)"), "api_path")
        .when(path.rlike(r"\.(?:json|xml|csv|jsonl|ndjson)$"), "data_file")
    )


def without_tracking(url: Column) -> Column:
    """The fragment and the tracking parameters ref and utm_* go."""
    c = F.regexp_replace(url, "#.*$", "")
    c = F.regexp_replace(c, "([?&])(?:ref|utm_[a-z]+)=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(c, "&+", "&"), "[?&]+$", "")


def domain_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: turns a suffix condition into an equality join."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
