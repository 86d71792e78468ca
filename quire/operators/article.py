"""Plain text of articles to chapters: junk lines out, headings by wording or number, sections between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import matches, part_of, strip

NUMBERED_BELOW = 500
TITLE_LINES = 20


def _run(order: str = "pos"):
    return Window.partitionBy("doc_id").orderBy(order)


def strip_junk(lines: DataFrame) -> DataFrame:
    """Stripped lines without blank ones, page numbers and journal headers, numbered anew from 0."""
    kept = lines.withColumn("line", strip(F.col("line"))).where(F.col("line") != "").where(~matches(F.col("line"), P.JUNK, True))
    return kept.select("doc_id", (F.row_number().over(_run()) - 1).alias("pos"), "line")


def headings(lines: DataFrame) -> DataFrame:
    """All lines, with `heading` where a heading begins; a heading equal to the one before (any case) is none."""
    line = F.col("line")
    short = F.char_length(line) <= 40
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    academic = short & ((capitals & matches(line, P.ACADEMIC_LINE)) | matches(line, P.CHAPTER_WORD, True) | matches(line, P.APPENDIX_WORD, True))
    word = F.lower(F.regexp_extract(strip(part_of(line, P.ARTICLE_NUMBERED, 2)), "^[^\\s\\p{Z}]+", 0))
    numbered = (F.char_length(line) <= 100) & matches(line, P.ARTICLE_NUMBERED) & ~word.isin(*P.BODY_STARTS)
    few = F.count("*").over(Window.partitionBy("doc_id")) < NUMBERED_BELOW
    found = lines.select("*", F.when(academic, F.regexp_replace(line, ":+$", "")).when(few & F.coalesce(numbered, F.lit(False)), line).alias("found"))
    before = F.last("found", ignorenulls=True).over(_run().rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("found").isNotNull() & (before.isNull() | (F.lower("found") != F.lower(before)))
    return found.select("doc_id", "pos", "line", F.when(fresh, F.col("found")).alias("heading"))


def sections(marked: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """doc_id, group_no, chunk_pos, heading, content, level, group_chapter_no.

    Text before the first heading is "Front Matter". Without front matter numbers run 1, 3, 4 and so on. A document without
    headings is one chapter, named by its stem (doc_id, stem) or its id.
    """
    rows = marked.withColumn("sec", F.count("heading").over(_run().rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.filter(F.array_sort(F.collect_list(F.struct("pos", "line", "heading"))), lambda x: x["heading"].isNull())
    out = rows.groupBy("doc_id", "sec").agg(F.max("heading").alias("heading"), strip(F.array_join(F.transform(texts, lambda x: x["line"]), "\n")).alias("content"))
    every = Window.partitionBy("doc_id")
    out = out.withColumn("last", F.max("sec").over(every)).withColumn("front", F.max((F.col("sec") == 0).cast("int")).over(every))
    named = F.lit(None).cast("string")
    if stems is not None:
        out, named = out.join(stems.select("doc_id", "stem"), "doc_id", "left"), F.col("stem")
    bare = F.col("last") == 0
    title = F.when(bare, F.coalesce(named, F.col("doc_id").cast("string"))).when(F.col("sec") == 0, "Front Matter").otherwise(F.col("heading"))
    number = F.when(bare | (F.col("sec") == 0), 1).when((F.col("front") == 0) & (F.col("sec") == 1), 1).otherwise(F.col("sec") + 1)
    group = F.when(bare, 1).otherwise(F.col("sec") + F.col("front"))
    return out.select("doc_id", group.cast("int").alias("group_no"), F.lit(0).alias("chunk_pos"), title.alias("heading"), "content", F.lit(2).alias("level"), number.cast("int").alias("group_chapter_no"))


def title(lines: DataFrame) -> DataFrame:
    """doc_id, title: the first lines up to one that stops a title; null where the first does."""
    line = F.col("line")
    low = F.lower(line)
    stop = matches(line, P.PERSON) | ((F.char_length(line) < 10) & (F.col("pos") > 0))
    for s in P.TITLE_STOPS:
        stop = stop | low.contains(s)
    rows = lines.where(F.col("pos") < TITLE_LINES).withColumn("stop", stop)
    rows = rows.withColumn("end", F.min(F.when(F.col("stop"), F.col("pos"))).over(Window.partitionBy("doc_id")))
    kept = F.when(F.col("end").isNull() | (F.col("pos") < F.col("end")), F.struct("pos", "line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), " ")
    return rows.groupBy("doc_id").agg(F.nullif(strip(joined), F.lit("")).alias("title"))
