"""Pages as spans: the contract for laid-out documents. PyMuPDF, where it is installed, turns PDF files into spans.

block_type is 0 for text; rows of other types carry none: images (1), one mark a page (PAGE), so that blank pages count, and the
error of a file that can't be read (ERROR, the message as text, on no page).
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import article as A
from ..operators import meta as M
from ..operators import pdf
from .registry import hold, register, stem_of

SPANS = (
    "doc_id string, page_no int, block_no int, line_no int, span_no int, block_type int, text string, size double, font string, flags int, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>"
)
PAGE, ERROR = -2, -1
META = "doc_id string, stem string, title string, author string, creationDate string, modDate string, language string"


def _pymupdf():
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("Reading PDF files needs PyMuPDF; give a table of spans instead") from e
    return pymupdf


def available() -> bool:
    return importlib.util.find_spec("pymupdf") is not None


def _opened(content):
    if content is None:
        raise ValueError("no content")
    book = _pymupdf().open(stream=bytes(content), filetype="pdf")
    if book.needs_pass:
        raise ValueError("the file is encrypted")
    return book


def _rows(doc: str, content) -> Iterator[tuple]:
    with _opened(content) as book:
        for p, page in enumerate(book):
            yield doc, p, -1, -1, -1, PAGE, None, None, None, None, None
            for b, block in enumerate(page.get_text("dict")["blocks"]):
                for n, line in enumerate(block.get("lines", [])):
                    box = dict(zip(("x0", "y0", "x1", "y1"), line["bbox"], strict=True))
                    for s, x in enumerate(line["spans"]):
                        yield doc, p, b, n, s, block["type"], x["text"], x["size"], x["font"], x["flags"], box


def errors(spans: DataFrame) -> DataFrame:
    """doc_id, error of files that couldn't be read."""
    return spans.where(F.col("block_type") == ERROR).select("doc_id", F.col("text").alias("error"))


def spans_of(files: DataFrame) -> DataFrame:
    _pymupdf()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc, content in zip(part["doc_id"], part["content"], strict=True):
                try:
                    rows = list(_rows(doc, content))
                except Exception as e:  # whatever the library raises for a file it can't read
                    rows = [(doc, None, -1, -1, -1, ERROR, f"{type(e).__name__}: {e}", None, None, None, None)]
                yield pd.DataFrame(rows, columns=["doc_id", "page_no", "block_no", "line_no", "span_no", "block_type", "text", "size", "font", "flags", "bbox"])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, SPANS)


def metadata_of(files: DataFrame) -> DataFrame:
    _pymupdf()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, stem, content in zip(part["doc_id"], part["stem"], part["content"], strict=True):
                try:
                    with _opened(content) as book:
                        m = book.metadata or {}
                except Exception:  # spans_of has the error
                    m = {}
                rows.append((doc, stem, *(m.get(k) for k in ("title", "author", "creationDate", "modDate", "language"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in META.split(", ")])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), stem_of(F.col("path")).alias("stem"), "content").mapInPandas(run, META)


def text_of(spans: DataFrame) -> DataFrame:
    """doc_id, text: lines in reading order."""
    cells = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    rows = spans.where("block_type = 0").groupBy("doc_id", "page_no", "block_no", "line_no").agg(F.array_join(F.transform(cells, lambda x: x["text"]), "").alias("line"))
    cells = F.array_sort(F.collect_list(F.struct("page_no", "block_no", "line_no", "line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(cells, lambda x: x["line"]), "\n").alias("text"))


def read_spans(spans: DataFrame, meta: DataFrame, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans and pdf_meta -> (books, chunks), by the fallback chain; an article's metadata is merged with the file's. A file that can't be
    read is a chunk with its error, and no book."""
    broken = errors(spans)
    spans, meta = spans.where(F.col("block_type") != ERROR), meta.join(broken.select("doc_id"), "doc_id", "left_anti")
    profiles = pdf.profile(spans)
    plain = A.strip_junk(lines(text_of(spans)))
    stems = meta.select("doc_id", "stem")
    chunks = pdf.chapters(pdf.rich_chunks(spans, profiles), profiles, A.sections(A.headings(plain), stems), mode)
    own = M.pdf_books(meta)
    merged = M.merge_books(M.article_books(meta, A.title(plain)), own)
    by_article = chunks.where("route = 'article'").select("doc_id").distinct()
    books = own.join(by_article, "doc_id", "left_anti").unionByName(merged.join(by_article, "doc_id", "left_semi"))
    return books, chunks.withColumn("error", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)


@register("pdf")
def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return read_spans(hold(spans_of(files)), metadata_of(files))
