"""Plain extraction and metadata by a file's extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.meta import pdf_books
from ..operators.pdf import line_markdown
from . import fb2, spans
from .registry import format_of, stem_of

BOOKS = "doc_id string, id string, title string, authors array<string>, language string, error string"


def _of(files: DataFrame, fmt: str) -> DataFrame:
    return files.where(format_of(F.col("path")) == fmt)


def markdown(files: DataFrame) -> DataFrame:
    """files(doc_id, path, content) -> doc_id, markdown, error: PDF and FB2; others have the error "Unsupported format"."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, content in zip(part["doc_id"], part["content"], strict=True):
                try:
                    rows.append((doc, fb2.plain_markdown(content), None))
                except (fb2.ET.ParseError, ValueError) as e:
                    rows.append((doc, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "markdown", "error"])

    named = files.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = _of(named, "fb2").select("doc_id", "content").mapInPandas(run, "doc_id string, markdown string, error string")
    kind = format_of(F.col("path"))
    out = out.unionByName(named.where(~kind.isin("fb2", "pdf")).select("doc_id", F.lit(None).cast("string").alias("markdown"), F.concat(F.lit("Unsupported format: "), kind).alias("error")))
    if spans.available():
        found = spans.spans_of(_of(named, "pdf"))
        out = out.unionByName(line_markdown(found).withColumn("error", F.lit(None).cast("string"))).unionByName(spans.errors(found), allowMissingColumns=True)
    return out


def metadata(files: DataFrame) -> DataFrame:
    """doc_id, id, title, authors, language, error: by the plain rules of each format; other files, and those that can't be read, are
    named by their stems."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, stem, content in zip(part["doc_id"], part["stem"], part["content"], strict=True):
                try:
                    rows.append((doc, stem, *fb2.plain_book(content, stem), None))
                except (fb2.ET.ParseError, ValueError) as e:
                    rows.append((doc, stem, stem, [], None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BOOKS.split(", ")])

    named = files.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "content", stem_of(F.col("path")).alias("stem"))
    out = _of(named, "fb2").select("doc_id", "stem", "content").mapInPandas(run, BOOKS)
    rest = named.where(~format_of(F.col("path")).isin("fb2", "pdf"))
    out = out.unionByName(rest.select("doc_id", F.col("stem").alias("id"), F.col("stem").alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("error")))
    if spans.available():
        pdf = pdf_books(spans.metadata_of(_of(named, "pdf"))).select("doc_id", "id", "title", "authors", "language")
        out = out.unionByName(pdf.join(spans.errors(spans.spans_of(_of(named, "pdf"))), "doc_id", "left"))
    return out
