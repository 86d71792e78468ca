"""FB2: parsed at the edge, in batches, to rows of chunks and of metadata. A file that can't be parsed gives its error, not a failed job."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .registry import register, stem_of

SPACE = "{http://www.gribuser.ru/xml/fictionbook/2.0}"
#: Inline elements and their marks.
MARKS = {"emphasis": "*", "strong": "**", "code": "`"}
CHUNKS = "doc_id string, group_no int, chunk_pos int, level int, heading string, content string, group_chapter_no int, error string"
BOOKS = "doc_id string, title string, authors array<string>, language string, year int, error string"


def name_of(tag: str) -> str:
    return tag.rpartition("}")[2]


def marked(node: ET.Element) -> str:
    """The text inside an element, with the marks of inline elements around theirs."""
    out: list[str] = []
    todo: list = [node.text, *_inner(node)][::-1]
    while todo:
        step = todo.pop()
        if isinstance(step, ET.Element):
            mark = MARKS.get(name_of(step.tag), "")
            todo += [step.tail, mark, *_inner(step)[::-1], step.text, mark]
        else:
            out.append(step or "")
    return "".join(out).strip()


def _inner(node: ET.Element) -> list[ET.Element]:
    return list(node)


def paragraphs(node: ET.Element) -> str:
    return " ".join(t for t in map(marked, node.findall(SPACE + "p")) if t)


def title_of(section: ET.Element) -> str:
    """Its title's paragraphs on one line; of a title without any, the title's own text."""
    title = section.find(SPACE + "title")
    if title is None:
        return ""
    return paragraphs(title) if title.find(SPACE + "p") is not None else marked(title)


#: What stands directly under a section, to markdown; other elements are left out.
BLOCK_FORMS = {"p": ("{}", marked), "subtitle": ("**{}**", marked), "cite": ("> {}", paragraphs)}


def blocks_of(section: ET.Element) -> str:
    forms = ((BLOCK_FORMS[k], child) for child in section if (k := name_of(child.tag)) in BLOCK_FORMS)
    return "\n\n".join(form.format(text) for (form, read), child in forms if (text := read(child)))


def chunks_of(content: bytes) -> Iterator[tuple[int, int, int, str, str]]:
    """(group, place, level, heading, content): sections of the first body are chapters, those inside subsections in reading order."""
    body = parsed(content).find(f".//{SPACE}body")
    for group, section in enumerate([] if body is None else body.findall(SPACE + "section"), 1):
        yield group, 0, 1, title_of(section) or f"Chapter {group}", blocks_of(section).strip()
        stack = [(s, 2) for s in reversed(section.findall(SPACE + "section"))]
        place = 0
        while stack:
            sub, depth = stack.pop()
            place += 1
            yield group, place, min(depth, 3), title_of(sub), blocks_of(sub).strip()
            stack += [(s, depth + 1) for s in reversed(sub.findall(SPACE + "section"))]


def book_of(content: bytes, stem: str) -> tuple[str, list[str], str, int | None]:
    info = parsed(content).find(f".//{SPACE}title-info")

    def text(node: ET.Element | None, tag: str) -> str:
        return "" if node is None else node.findtext(SPACE + tag, default="").strip()

    people = [] if info is None else info.findall(SPACE + "author")
    names = [f"{text(a, 'first-name')} {text(a, 'last-name')}".strip() for a in people]
    year = re.search(r"\d{4}", text(info, "date"))
    return text(info, "book-title") or stem, [n for n in names if n], text(info, "lang") or "en", int(year[0]) if year else None


def parsed(content) -> ET.Element:
    if content is None:
        raise ValueError("no content")
    return ET.fromstring(bytes(content))


def flat_text(node: ET.Element) -> str:
    """Stripped texts joined by spaces, what follows the element too; elements other than paragraphs count one level deep."""
    found = [node.text]
    for child in node:
        found += [flat_text(child)] if child.tag in (SPACE + "p", "p") else [child.text, child.tail]
    return " ".join(filter(None, ((t or "").strip() for t in [*found, node.tail])))


def plain_markdown(content: bytes) -> str:
    """The first body's titles, as headings by depth, and paragraphs, a blank line after each: the plain extraction."""
    body = parsed(content).find(f".//{SPACE}body")
    if body is None:
        raise ValueError("No <body> found in fb2")
    out: list[str] = []
    stack = [(body, 0)]
    while stack:
        node, depth = stack.pop()
        kind = name_of(node.tag)
        if kind in ("title", "p"):
            text = flat_text(node)
            if text:
                out += [("#" * min(depth + 1, 6) + " " if kind == "title" else "") + text, ""]
        else:
            stack += [(child, depth + (kind == "section")) for child in reversed(node)]
    return "\n".join(out)


def plain_book(content: bytes, stem: str) -> tuple[str, list[str], str | None]:
    """Title, authors and language by the plain rules: the language may stand anywhere; without title-info there is none."""
    root = parsed(content)
    info = root.find(f".//{SPACE}title-info")
    if info is None:
        return stem, [], None
    title = info.find(SPACE + "book-title")
    names = [" ".join((a.findtext(SPACE + "first-name", default=""), a.findtext(SPACE + "last-name", default=""))).strip() for a in info.findall(SPACE + "author")]
    return stem if title is None else flat_text(title), [n for n in names if n], root.findtext(f".//{SPACE}lang", default="en")


def chunks(files: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, content in zip(part["doc_id"], part["content"], strict=True):
                try:
                    rows += [(doc, g, p, level, h, c, g, None) for g, p, level, h, c in chunks_of(content)]
                except (ET.ParseError, ValueError) as e:
                    rows.append((doc, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, CHUNKS)


def books(files: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, stem, content in zip(part["doc_id"], part["stem"], part["content"], strict=True):
                try:
                    rows.append((doc, *book_of(content, stem), None))
                except (ET.ParseError, ValueError) as e:
                    rows.append((doc, stem, [], "en", None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BOOKS.split(", ")])

    raw = files.select(F.col("doc_id").cast("string").alias("doc_id"), stem_of(F.col("path")).alias("stem"), "content").mapInPandas(run, BOOKS)
    return raw.select("*", slug(F.col("title")).alias("id"), F.lit("fb2").alias("source_format"), F.lit("technical").alias("book_type"))


@register("fb2")
def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return books(files), chunks(files)
