"""HTML pages as blocks: the page's events in a row first, then a pass that forms paragraphs, headings and tables of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import pairwise

from .text import plain

#: Parts of a page that hold no text of its own, headings, and tags that end a block.
SKIPPED = frozenset({"script", "style", "nav", "header", "footer", "noscript", "head", "title"})
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
BREAKING = frozenset("p div li tr section article main ul ol dl dd dt blockquote pre body address hr aside table".split())
BLOCK = "array<struct<kind: string, text: string>>"

_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)", re.IGNORECASE)
Event = tuple[str, str]


class _Events(HTMLParser):
    """(open, tag), (close, tag) and (text, data), as they come."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[Event] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen.append(("open", tag))

    def handle_endtag(self, tag: str) -> None:
        self.seen.append(("close", tag))

    def handle_data(self, data: str) -> None:
        self.seen.append(("text", data))


def decoded(page: bytes) -> str:
    """A page's text by the character set it names in its first 4096 bytes, else UTF-8."""
    named = _CHARSET.search(page[:4096])
    try:
        return page.decode(named[1].decode("ascii") if named else "utf-8", "replace")
    except LookupError:
        return page.decode("utf-8", "replace")


def _visible(events: list[Event]) -> Iterator[Event]:
    hidden = 0
    for what, value in events:
        if what != "text" and value in SKIPPED:
            hidden = max(0, hidden + (1 if what == "open" else -1))
        elif not hidden:
            yield what, value


def _depths(events: list[Event]) -> list[int]:
    """How many tables are open after each event."""
    depth, out = 0, []
    for what, value in events:
        if value == "table" and what != "text":
            depth = max(0, depth + (1 if what == "open" else -1))
        out.append(depth)
    return out


def _flow(events: list[Event]) -> Iterator[dict]:
    """Paragraphs and headings of what is outside tables: each breaking tag ends one and says what the next one is."""
    kind, parts = "para", []
    for what, value in [*events, ("close", "body")]:
        if what == "text":
            parts.append(value)
        elif value == "br" and what == "open":
            parts.append(" ")
        elif value in HEADINGS or value in BREAKING:
            if text := plain("".join(parts)):
                yield {"kind": kind, "text": text}
            kind, parts = ("heading" if what == "open" and value in HEADINGS else "para"), []


def _rows(events: list[Event], depths: list[int]) -> list[list[str]]:
    """The cells of a table by row; what is in tables inside it belongs to the cell."""
    rows: list[list[list[str]]] = []
    cell: list[str] | None = None
    for (what, value), depth in zip(events, depths, strict=True):
        if what == "text":
            if cell is not None:
                cell.append(value)
        elif depth > 1:
            continue
        elif value == "tr":
            cell = None
            if what == "open" or not rows:
                rows.append([])
        elif value in ("td", "th"):
            cell = [] if what == "open" else None
            if what == "open":
                if not rows:
                    rows.append([])
                rows[-1].append(cell)
        elif cell is not None and value in BREAKING:
            cell.append(" ")
    return [[plain("".join(c)) for c in row] for row in rows]


def table_blocks(rows: list[list[str]]) -> list[dict]:
    """One block of the whole table and one for each row below the first, its cells named by the first row."""
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    names = [name or f"Column {k + 1}" for k, name in enumerate(rows[0] + [""] * max(map(len, rows)))]
    told = ["; ".join(f"{names[k]}: {cell}" for k, cell in enumerate(row) if cell) for row in rows[1:]]
    return [{"kind": "table", "text": "\n".join(" | ".join(r) for r in rows)}, *({"kind": "table_row", "text": t} for t in told)]


def blocks(page: str | None) -> list[dict]:
    """The blocks of a page; an unclosed table ends with the page."""
    parser = _Events()
    parser.feed(page or "")
    parser.close()
    events = list(_visible(parser.seen))
    depths = _depths(events)
    edges = [0, *(k for k in range(1, len(events)) if (depths[k] > 0) != (depths[k - 1] > 0)), len(events)]
    out: list[dict] = []
    for a, b in pairwise(edges):
        out += table_blocks(_rows(events[a:b], depths[a:b])) if a < b and depths[a] else _flow(events[a:b])
    return out
