"""HTML pages as block rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that are dropped whole, tags that become blocks, shortest block.
DROPPED = frozenset(["script", "style", "nav", "header", "footer", "noscript", "aside"])
BLOCK_TAGS = frozenset(["p", "h1", "h2", "h3", "li", "td"])
HEADING_TAGS = frozenset(["h1", "h2", "h3"])
MIN_BLOCK_CHARS = 20
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])

PIECE_CHARS = 4_000_000  # of blocks held by a worker

BLOCKS_SCHEMA = "page_id long, title string, ord long, kind string, location string, text string"
BLOCK_NAMES = ["page_id", "title", "ord", "kind", "location", "text"]
BLOCK_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


class _Blocks(HTMLParser):
    """Collects (tag, text pieces) of block elements in document order; open elements nest."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.title: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        slot = None
        if tag in BLOCK_TAGS and not self._dropped():
            slot = len(self.found)
            self.found.append((tag, []))
        self.open.append((tag, slot))

    def handle_endtag(self, tag):
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        if not data.strip() or self._dropped():
            return
        if self.open and self.open[-1][0] == "title" and self.title is None:
            self.title = [data.strip()]
        for _, slot in self.open:
            if slot is not None:
                self.found[slot][1].append(data.strip())

    def _dropped(self) -> bool:
        return any(t in DROPPED for t, _ in self.open)


def _table_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), BLOCK_TYPES, strict=True)], BLOCK_NAMES)


def _page_rows(batches: Iterator[pa.RecordBatch], piece: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Blocks of pages (page_id, html, fallback), given on whenever ``piece`` characters of them are held."""
    for batch in batches:
        rows, held = [], 0
        for page_id, html, fallback in zip(*batch.columns, strict=True):
            parser = _Blocks()
            parser.feed(html.as_py() or "")
            parser.close()
            page, title = page_id.as_py(), parser.title[0] if parser.title else fallback.as_py()
            for i, (tag, pieces) in enumerate(parser.found):
                text = re.sub(r"\s+", " ", " ".join(pieces)).strip()
                if len(text) >= MIN_BLOCK_CHARS:
                    kind = "heading" if tag in HEADING_TAGS else "paragraph"
                    rows.append((page, title, i, kind, f"para {i}", text))
                    held += len(text) + len(title or "")
                    if held >= piece:
                        yield _table_of(rows)
                        rows, held = [], 0
        if rows:
            yield _table_of(rows)


def title_from_url(url: Column) -> Column:
    """Host and path without outer slashes, the address itself if both are empty."""
    bare = F.concat(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    trimmed = F.regexp_replace(bare, "^/+|/+$", "")
    return F.when(trimmed != "", trimmed).otherwise(url)


def html_blocks(pages: DataFrame) -> DataFrame:
    """Block rows of ``pages(page_id, url, html)``; pages are parsed batch by batch where they lie."""
    return pages.select("page_id", "html", title_from_url(F.col("url")).alias("fallback")).mapInArrow(_page_rows, BLOCKS_SCHEMA)
