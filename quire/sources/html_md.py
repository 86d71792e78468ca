"""HTML to markdown: ATX headings, dashes for bullets, tables with a rule under their head (an empty one where the first row isn't of
heading cells), images left out. An event parser, so malformed pages do no harm."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = {"script", "style", "head", "title", "template"}
BLOCKS = {"p", "div", "article", "section", "header", "footer", "nav", "main", "dl", "dt", "dd", "figure"}
INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []  # finished ones
        self.now: list[str] = []
        self.prefix = ""
        self.skip = 0
        self.pre = 0
        self.lists: list[list] = []  # [tag, number]
        self.quotes = 0
        self.links: list[tuple[str, int]] = []
        self.open: list[tuple[str, int]] = []  # inline marks and where they begin
        self.rows: list[list[tuple[str, bool]]] | None = None  # of the open table: cells' texts, and whether they are headings
        self.cell: tuple[bool, int] | None = None  # the open cell: heading or not, and where it begins
        self.nested = 0  # tables inside cells, which are text

    def cut(self) -> None:
        for mark, at in reversed(self.open):
            self.wrap(mark, at)
        self.open = []
        text = "".join(self.now)
        text = text.strip("\n") if self.pre else re.sub(r"[ \t\r\f]*\n[ \t\r\f]*", "\n", re.sub(r"[ \t\r\f]+", " ", text)).strip()
        if text:
            self.blocks.append("> " * self.quotes + self.prefix + text)
            self.prefix = ""
        self.now = []

    def wrap(self, mark: str, at: int) -> None:
        inner = "".join(self.now[at:])
        core = inner.strip()
        if core:
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            self.now[at:] = [f"{lead and ' '}{mark}{core}{mark}{tail and ' '}"]

    def end_cell(self) -> None:
        if self.cell is not None:
            heading, at = self.cell
            while self.open and self.open[-1][1] >= at:
                self.wrap(*self.open.pop())
            self.rows[-1].append((" ".join("".join(self.now[at:]).split()), heading))
            del self.now[at:]
            self.cell = None

    def end_table(self) -> None:
        self.end_cell()
        rows, self.rows, self.now = [r for r in self.rows if r], None, []
        if rows:
            head = rows.pop(0) if all(h for _, h in rows[0]) else [("", True)] * len(rows[0])
            lines = [[t for t, _ in head], ["---"] * len(head), *([t for t, _ in r] for r in rows)]
            self.now = ["\n".join(f"| {' | '.join(cells)} |" for cells in lines)]
            self.blocks.append("> " * self.quotes + self.now.pop())

    def table_start(self, tag: str) -> bool:
        """Whether the tag belongs to a table; blocks inside a cell are text there."""
        if self.rows is None:
            if tag == "table":
                self.cut()
                self.rows = []
            return tag == "table"
        if tag == "table":
            self.nested += 1
        if self.nested and tag in ("tr", "td", "th"):
            self.now.append(" ")
        elif tag == "tr":
            self.end_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self.end_cell()
            if not self.rows:
                self.rows.append([])
            self.cell = (tag == "th", len(self.now))
        elif tag in INLINE or tag == "a":
            return False
        else:
            self.now.append(" ")
        return True

    def table_end(self, tag: str) -> bool:
        if self.rows is None or tag in INLINE or tag == "a":
            return False
        if tag == "table":
            if self.nested:
                self.nested -= 1
            else:
                self.end_table()
        elif tag in ("td", "th", "tr") and not self.nested:
            self.end_cell()
        else:
            self.now.append(" ")
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif self.skip or self.table_start(tag):
            return
        elif re.fullmatch("h[1-6]", tag):
            self.cut()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.cut()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.cut()
            if self.lists:
                self.lists[-1][1] += 1
            depth = max(0, len(self.lists) - 1)
            kind = self.lists[-1] if self.lists else ["ul", 0]
            self.prefix = "  " * depth + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
        elif tag == "blockquote":
            self.cut()
            self.quotes += 1
        elif tag == "pre":
            self.cut()
            self.pre += 1
        elif tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.now.append("  \n" if self.pre else "\n")
        elif tag == "hr":
            self.cut()
            self.blocks.append("---")
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.now)))
        elif tag in INLINE and not self.pre:
            self.open.append((INLINE[tag], len(self.now)))

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip or self.table_end(tag):
            return
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS or tag == "li":
            if tag[0] == "h" and tag[1:].isdigit():
                self.now = [re.sub(r"\s+", " ", "".join(self.now))]
            self.cut()
            self.prefix = "" if tag != "li" else self.prefix
        elif tag in ("ul", "ol"):
            self.cut()
            self.prefix = ""
            if self.lists:
                self.lists.pop()
        elif tag == "blockquote":
            self.cut()
            self.quotes = max(0, self.quotes - 1)
        elif tag == "pre" and self.pre:
            text = "".join(self.now).strip("\n")
            self.now = []
            self.pre -= 1
            self.blocks.append(f"```\n{text}\n```")
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            text = "".join(self.now[at:]).strip()
            if href and text:
                self.now[at:] = [f"[{text}]({href})"]
        elif tag in INLINE:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == INLINE[tag]:
                    self.wrap(*self.open.pop(i))
                    break

    def handle_data(self, data: str) -> None:
        if not self.skip and (self.rows is None or self.cell is not None):  # what stands between cells is dropped
            self.now.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str) -> str:
    """The body, or the whole of a page without one."""
    found = re.search(r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\Z)", html)
    writer = _Writer()
    writer.feed(found[1] if found else html)
    writer.close()
    if writer.rows is not None:  # a table that isn't closed
        writer.end_table()
    writer.cut()
    out = ""
    for before, block in zip([None, *writer.blocks], writer.blocks, strict=False):
        item = re.match(r" *(-|\d+\.) ", block) is not None
        close = before is not None and item and re.match(r" *(-|\d+\.) ", before) is not None
        out += ("" if before is None else "\n" if close else "\n\n") + block
    return out


@F.pandas_udf(StringType())
def markdown_of(html: pd.Series) -> pd.Series:
    return html.map(lambda h: "" if h is None else to_markdown(h))
