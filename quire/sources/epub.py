"""EPUB: the archive is read at the edge to tables of contents, spine, items and metadata; the rest is joins and windows."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank, part_of, slug, strip
from ..operators.meta import first_year, split_epub_author
from ..operators.split import joined
from .html_md import markdown_of
from .registry import hold, register, stem_of

PARTS = "doc_id string, kind string, ord int, name string, value string, media_type string, content string"


def parts_of(content: bytes) -> Iterator[tuple]:
    """(kind, ord, name, value, media type, content): kind is toc (name: title, value: href), spine (name: id), item (name: id,
    value: href) or dc (name, value)."""
    if content is None:
        raise ValueError("no content")
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        root = ET.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.attrib["full-path"] for e in root.iter() if e.tag.endswith("}rootfile") or e.tag == "rootfile")
        base, opf = posixpath.dirname(opf_path), ET.fromstring(z.read(opf_path))
        names = set(z.namelist())

        def local(e: ET.Element) -> str:
            return e.tag.rpartition("}")[2]

        def read(href: str) -> str | None:
            path = posixpath.normpath(posixpath.join(base, unquote(href)))
            return z.read(path).decode("utf-8", "replace") if path in names else None

        items, order = {}, {}
        for e in opf.iter():
            if "purl.org/dc/elements" in e.tag and (e.text or "").strip():
                kind = local(e)
                order[kind] = order.get(kind, -1) + 1
                yield "dc", order[kind], kind, e.text.strip(), None, None
            elif local(e) == "item" and "href" in e.attrib:
                items[e.attrib.get("id", "")] = e.attrib
        for i, (key, a) in enumerate(items.items()):
            media = a.get("media-type", "")
            yield "item", i, key, a["href"], media, read(a["href"]) if "html" in media else None
        spine = next((e for e in opf.iter() if local(e) == "spine"), None)
        for i, e in enumerate([] if spine is None else [x for x in spine if local(x) == "itemref"]):
            yield "spine", i, e.attrib.get("idref", ""), None, None, None
        ncx = items.get(spine.attrib.get("toc", "") if spine is not None else "") or next((a for a in items.values() if a.get("media-type") == "application/x-dtbncx+xml"), None)
        nav = next((a for a in items.values() if "nav" in a.get("properties", "").split()), None)
        found: list[tuple[str, str]] = []
        if ncx is not None and (text := read(ncx["href"])):
            table = next((e for e in ET.fromstring(text).iter() if local(e) == "navMap"), [])
            for point in (p for p in table if local(p) == "navPoint"):
                label = next((t.text or "" for t in point.iter() if local(t) == "text"), "")
                src = next((c.attrib.get("src", "") for c in point if local(c) == "content"), "")
                found.append((label.strip(), src))
        elif nav is not None and (text := read(nav["href"])):
            table = next((e for e in ET.fromstring(text).iter() if local(e) == "ol"), [])
            for entry in table:
                link = next((c for c in entry if local(c) == "a"), None)
                if link is not None:
                    found.append(("".join(link.itertext()).strip(), link.attrib.get("href", "")))
        for i, (title, href) in enumerate(found):
            yield "toc", i, title, href, None, None


def parts(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows += [(doc, *p) for p in parts_of(content)]
                # not an archive, a part that is missing or broken, an encrypted one, an unknown compression
                except (zipfile.BadZipFile, KeyError, StopIteration, ET.ParseError, ValueError, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
                    rows.append((doc, "error", 0, type(e).__name__, str(e), None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, PARTS)


def toc_documents(toc: DataFrame, items: DataFrame) -> DataFrame:
    """toc(doc_id, ord, title, href), items(doc_id, item_id, href, ...) -> the items in the order of the table of contents, with chapter_no
    and toc_title. Entries without href are left out, fragments cut, the first entry of a document counts, and a missing item takes no number."""
    entries = toc.where("href <> ''").withColumn("href", F.split_part("href", F.lit("#"), F.lit(1)))
    once = Window.partitionBy("doc_id", "href").orderBy("ord")
    entries = entries.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    found = entries.join(items, ["doc_id", "href"]).withColumnRenamed("title", "toc_title")
    return found.withColumn("chapter_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))


def spine_documents(spine: DataFrame, items: DataFrame, toc: DataFrame) -> DataFrame:
    """spine(doc_id, ord, item_id): the documents in spine order, of books without an entry in their table of contents."""
    pages = items.where(F.col("media_type").contains("html"))
    rest = spine.join(toc.where("href <> ''").select("doc_id").distinct(), "doc_id", "left_anti")
    found = rest.join(pages, ["doc_id", "item_id"])
    return found.select("*", F.lit("").alias("toc_title"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("chapter_no"))


def chapter_chunks(pages: DataFrame) -> DataFrame:
    """pages(doc_id, chapter_no, toc_title, markdown) -> chunks: the chapter, then its sections.

    The first level-1 heading names a chapter without a title; each closes the open section and is left out. Deeper headings
    open sections of level 2 or 3. Lines outside sections are the chapter's. Lines are dealt by chapter once.
    """
    rows = pages.select("doc_id", "chapter_no", "toc_title", F.posexplode(F.split("markdown", "\n", -1)).alias("pos", "line"))
    line = F.col("line")
    rows = rows.select("*", F.char_length(part_of(line, P.MD_HEADING, 1)).alias("lvl"), strip(part_of(line, P.MD_HEADING, 2)).alias("name"))
    whole = Window.partitionBy("doc_id", "chapter_no")
    run = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sec", F.count("lvl").over(run)).withColumn("in_sec", F.coalesce(F.last("lvl", ignorenulls=True).over(run) > 1, F.lit(False)))
    rows = rows.withColumn("place", F.when(F.col("in_sec"), F.col("sec")).otherwise(0))
    opens = F.col("lvl") > 1
    text = F.col("lvl").isNull()
    out = rows.groupBy("doc_id", "chapter_no", "place").agg(
        F.max("toc_title").alias("toc_title"), F.min_by("name", F.when(F.col("lvl") == 1, F.col("pos"))).alias("first"),
        F.max(F.when(opens, F.col("name"))).alias("heading"), F.max(F.when(opens, F.least("lvl", F.lit(3)))).alias("level"), strip(joined(text, "pos", "line")).alias("content"),
    )
    title = F.coalesce(blank(strip(F.coalesce("toc_title", F.lit("")))), blank(F.col("first")), F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string")))
    at_head = F.col("place") == 0
    own = F.struct("place", F.when(at_head, title).otherwise(F.col("heading")).alias("heading"), F.when(at_head, 1).otherwise(F.col("level")).alias("level"), "content")
    # a chapter whose lines all lie in sections has a row too, before its first section's
    bare = F.struct(F.lit(0).cast("long").alias("place"), title.alias("heading"), F.lit(1).alias("level"), F.lit("").alias("content"))
    lacks = (F.col("place") > 0) & (F.row_number().over(whole.orderBy("place")) == 1)
    out = out.withColumn("place", F.col("place").cast("long")).withColumn("lacks", lacks)
    out = out.select("doc_id", "chapter_no", F.explode(F.when(F.col("lacks"), F.array(bare, own)).otherwise(F.array(own))).alias("x")).select("doc_id", "chapter_no", "x.*")
    number = F.row_number().over(whole.orderBy("place")) - 1
    return out.select("doc_id", F.col("chapter_no").cast("int").alias("group_no"), number.cast("int").alias("chunk_pos"), "heading", F.col("level").cast("int").alias("level"), "content", F.col("chapter_no").cast("int").alias("group_chapter_no"))


def books(dc: DataFrame, files: DataFrame) -> DataFrame:
    """dc(doc_id, name, ord, value): the first title, language and date, and all creators."""
    def first(n: str):
        return F.min_by("value", F.when(F.col("name") == n, F.col("ord")))

    creators = F.array_sort(F.collect_list(F.when(F.col("name") == "creator", F.struct("ord", "value"))))
    got = dc.groupBy("doc_id").agg(first("title").alias("title"), first("language").alias("language"), first("date").alias("date"), F.flatten(F.transform(creators, lambda x: split_epub_author(x["value"]))).alias("authors"))
    got = files.select(F.col("doc_id").cast("string").alias("doc_id"), stem_of(F.col("path")).alias("stem")).join(got, "doc_id", "left")
    title = strip(F.coalesce(blank(F.col("title")), F.col("stem")))
    return got.select("doc_id", title.alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.coalesce(blank(F.col("language")), F.lit("en")).alias("language"),
                      first_year(F.col("date")).alias("year"), slug(title).alias("id"), F.lit("epub").alias("source_format"), F.lit("technical").alias("book_type"))


@register("epub")
def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A file that can't be read is a chunk with its error, and no book. The parsed parts are held for the branches below."""
    rows = hold(parts(files))
    broken = rows.where("kind = 'error'").select("doc_id", F.concat_ws(": ", "name", "value").alias("error"))
    items = rows.where("kind = 'item'").select("doc_id", F.col("name").alias("item_id"), F.col("value").alias("href"), "media_type", "content")
    toc = rows.where("kind = 'toc'").select("doc_id", "ord", F.col("name").alias("title"), F.col("value").alias("href"))
    spine = rows.where("kind = 'spine'").select("doc_id", "ord", F.col("name").alias("item_id"))
    cols = ["doc_id", "chapter_no", "toc_title", "content"]
    pages = toc_documents(toc, items).select(*cols).unionByName(spine_documents(spine, items, toc).select(*cols))
    marked = pages.select("doc_id", "chapter_no", "toc_title", markdown_of(F.coalesce("content", F.lit(""))).alias("markdown"))
    chunks = chapter_chunks(marked).withColumn("error", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)
    whole = files.withColumn("doc_id", F.col("doc_id").cast("string")).join(broken.select("doc_id"), "doc_id", "left_anti")
    return books(rows.where("kind = 'dc'").select("doc_id", "name", "ord", "value"), whole.select("doc_id", "path")), chunks
