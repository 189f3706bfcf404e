"""URL and HTML helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def last_segment(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "[^/]*$", 0)


def path_language(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^https?://[^/]+/([a-z]{2})/", 1), F.lit(""))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def wiki_parts(url: Column) -> Column:
    """struct<lang, title> of an encyclopedia url; nulls for others."""
    pattern = r"^https?://([a-zA-Z]{2,3})\.wikipedia\.org/wiki/([^?#]+)"
    return F.struct(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")).alias("lang"), F.nullif(F.regexp_extract(url, pattern, 2), F.lit("")).alias("title"))


def allowed_domain(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or a subdomain of one."""
    found = F.lit(False)
    for d in domains:
        found = found | (host(url) == d) | F.endswith(host(url), F.lit(f".{d}"))
    return found


def html_text(html: Column) -> Column:
    """Scripts, styles and tags out, basic entities decoded, one-spaced."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(bare, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), F.lit(""))
