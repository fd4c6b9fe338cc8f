"""HTML to text (Arrow batches over the standard library's parser)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import MAX_TEXT_CHARS, normalize_text, truncate

# Elements whose subtrees are no content, and elements without an end tag.
REMOVED = frozenset("script style noscript header footer".split())
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())


class _Text(HTMLParser):
    """Text nodes outside removed subtrees; an element ends with its end tag or that of one around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in REMOVED

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.hidden -= last in REMOVED
                if last == tag:
                    return

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def page_text(html: str | None) -> str | None:
    """Text nodes joined without a separator, whitespace collapsed; null stays null."""
    if html is None:
        return None
    parser = _Text()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a malformed declaration ends the page
        pass
    return " ".join("".join(parser.parts).split())


def clean_html(html: Column) -> Column:
    """Column form of :func:`page_text`."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([page_text(x) for x in pages], dtype=object)

    return run(html)


def preprocess_html(html: Column, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """Cleaned and normalized text of a page, cut off at ``max_chars``."""
    return truncate(normalize_text(clean_html(html)), max_chars)
