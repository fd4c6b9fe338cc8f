"""URL functions: keys, normalization against a parent and link extraction."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def url_key(url: Column) -> Column:
    """The URL up to its first ``#`` without any trailing ``/``; null stays null."""
    return F.regexp_replace(F.substring_index(url, "#", 1), "/+$", "")


def resolve_url(href: str | None, base: str | None, allowed_domain: str | None = None) -> str | None:
    """Absolute form of a link, or None if it leaves http(s) or the allowed host.

    Fragments go, and so do all slashes at the very end, even behind a query.
    Malformed links give None rather than an error.
    """
    if href is None or base is None:
        return None
    try:
        absolute = urldefrag(urljoin(base, href)).url
        parts = urlparse(absolute)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https"):
        return None
    if allowed_domain and parts.netloc != allowed_domain:
        return None
    return absolute.rstrip("/")


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            for name, value in attrs:
                if name == "href":
                    self.hrefs.append(value or "")
                    break


def page_links(html: str | None, base: str | None, allowed_domain: str | None = None) -> list[str] | None:
    """Distinct normalized links of a page in ascending order; null html gives null."""
    if html is None:
        return None
    parser = _Anchors()
    try:
        parser.feed(html)
        parser.close()
    except (ValueError, AssertionError):
        pass
    found = {resolve_url(h, base, allowed_domain) for h in parser.hrefs}
    return sorted(x for x in found if x)


def normalize_url(href: Column, base: Column, allowed_domain: str | None = None) -> Column:
    """Column form of :func:`resolve_url` (Arrow batches)."""

    @F.pandas_udf("string")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resolve_url(x, y, allowed_domain) for x, y in zip(h, b)], dtype=object)

    return run(href, base)


def extract_links(html: Column, base: Column, allowed_domain: str | None = None) -> Column:
    """Column form of :func:`page_links` (Arrow batches)."""

    @F.pandas_udf("array<string>")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([page_links(x, y, allowed_domain) for x, y in zip(h, b)], dtype=object)

    return run(html, base)


def authority(url: Column) -> Column:
    """Host and port of a URL."""
    return F.parse_url(url, F.lit("AUTHORITY"))


def host_key(url: Column) -> Column:
    """Lower-case authority, or an empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
