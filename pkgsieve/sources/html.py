"""Elements of HTML pages (S6, S7, S14, S15): an event parser over the page.

Pages are read as a browser's tokenizer reads them -- tags, quoted attributes
(which may hold ``>``), comments, raw text, character references by name and
number -- with the standard library's event parser inside an Arrow UDF.  A
small stack of open tags gives each element its text:

* an end tag closes the last open element of its name and all opened in it;
  one that closes nothing is skipped;
* a list item ends the item before it in the same list;
* an element never closed ends with the page;
* comments, scripts and styles are no text.

A null page has no elements; pages of any length are read whole, one at a time.
"""
from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code

ELEMENTS = "array<struct<href:string,text:string>>"
# Elements without content, elements whose content is no text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
LISTS = {"ul", "ol", "menu", "dir"}


class Elements(HTMLParser):
    """Collects (href, text) of the elements of one tag, in document order."""

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self.wanted = tag
        self.open: list[tuple[str, list | None]] = []  # tag, its element if wanted
        self.found: list[list] = []  # href, pieces of text

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag == "li":
            names = [t for t, _ in self.open]
            last = max((k for k, t in enumerate(names) if t == "li" or t in LISTS), default=-1)
            if last >= 0 and names[last] == "li":
                del self.open[last:]
        element = None
        if tag == self.wanted:
            element = [dict(attrs).get("href"), []]
            self.found.append(element)
        self.open.append((tag, element))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] in RAW:
            return
        for _, element in self.open:
            if element is not None:
                element[1].append(data)


def read(page: str, tag: str) -> list[tuple[str | None, str]]:
    parser = Elements(tag)
    parser.feed(page)
    parser.close()
    return [(href, "".join(text)) for href, text in parser.found]


def elements(page: Column, tag: str) -> Column:
    """(href, text) of every element ``tag`` of a page."""
    ship_code(SparkSession.active())

    @F.arrow_udf(ELEMENTS)
    def run(pages: pa.Array) -> pa.Array:
        found = [[{"href": h, "text": t} for h, t in read(p.as_py(), tag)] if p.is_valid else [] for p in pages]
        return pa.array(found, pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))

    return run(page)
