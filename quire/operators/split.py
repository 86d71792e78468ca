"""Markdown lines to chunks, their numbering, content window, filters and chapter groups: windows over one shuffle by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank, matches, number_of, part_of, strip


def _by(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)


def joined(lines: Column, pos: str, text: str, sep: str = "\n") -> Column:
    """Aggregate: texts in the order of pos."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(lines, F.struct(F.col(pos), F.col(text))))), lambda x: x[text]), sep)


def split_markdown(lines: DataFrame) -> DataFrame:
    """lines(doc_id, pos, line) -> doc_id, sequence, heading, content, level, part.

    Headings of level 2 and more open chunks; a level-1 heading that names a part ends a chunk and is carried forward; other
    level-1 headings vanish. Chunks without content are dropped and take no number.
    """
    mark = F.col("line")
    rows = lines.select(
        "doc_id", "pos", "line", F.char_length(part_of(mark, P.MD_HEADING, 1)).alias("level"), part_of(mark, P.MD_HEADING, 2).alias("title")
    ).withColumn("is_part", (F.col("level") == 1) & matches(F.col("title"), P.PART, True))
    rows = rows.where("level is null or level > 1 or is_part")
    w = _by("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chunk", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w)).withColumn(
        "part", F.last(F.when(F.col("is_part"), F.col("title")), ignorenulls=True).over(w)
    )
    opens = F.col("level") > 1
    chunks = rows.groupBy("doc_id", "chunk").agg(
        F.max(F.when(opens, F.col("title"))).alias("heading"),
        F.max(F.when(opens, F.col("level"))).alias("level"),
        strip(joined(F.col("level").isNull(), "pos", "line")).alias("content"),
        F.coalesce(F.max_by("part", "pos"), F.lit("")).alias("part"),
    )
    chunks = chunks.where("heading is not null and content <> ''")
    return chunks.select("doc_id", (F.row_number().over(_by("chunk")) - 1).alias("sequence"), "heading", "content", "level", "part")


def enrich(chunks: DataFrame, order: str = "sequence") -> DataFrame:
    """Adds chapter_no, chapter_title, section_no, section_title, sequence_str and carries part forward."""
    run = _by(order).rowsBetween(Window.unboundedPreceding, 0)
    h = F.col("heading")
    named = chunks.select(
        "*",
        (F.col("level") <= 2).alias("_opens"),
        F.when(F.col("level") <= 2, F.coalesce(number_of(h, P.H2_NUM, 1, True), number_of(h, P.H2_NUM, 2, True))).alias("_num"),
        F.when(F.col("level") == 3, number_of(h, P.H3_DOTTED, 1, True)).alias("_over"),
        F.when(F.col("level") == 3, F.coalesce(number_of(h, P.H3_DOTTED, 2, True), number_of(h, P.H3_WORD, 1, True), number_of(h, P.H3_PLAIN, 1))).alias("_sec"),
    )
    named = named.select(
        "*",
        F.count("_num").over(run).alias("_island"),
        F.sum(F.col("_opens").cast("int")).over(run).alias("_ord"),
        F.coalesce(F.last(blank(F.col("part")), ignorenulls=True).over(run), F.lit("")).alias("_part"),
    )
    island, own = Window.partitionBy("doc_id", "_island"), Window.partitionBy("doc_id", "_ord")
    upto = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counter = F.coalesce(F.max("_num").over(island), F.lit(0)) + F.sum(F.when(F.col("_opens") & F.col("_num").isNull(), 1).otherwise(0)).over(
        island.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    third = F.col("level") == 3
    counted = F.sum(F.when(third & F.col("_sec").isNull(), 1).otherwise(0)).over(upto)
    out = named.select(
        *[c for c in chunks.columns if c != "part"],
        F.col("_part").alias("part"),
        F.coalesce(F.last("_over", ignorenulls=True).over(upto), counter).cast("int").alias("chapter_no"),
        F.when(F.col("_ord") > 0, F.first("heading").over(upto)).otherwise("").alias("chapter_title"),
        F.when(third, F.coalesce("_sec", counted)).otherwise(0).cast("int").alias("section_no"),
        F.when(third, h).otherwise("").alias("section_title"),
    )
    return out.withColumn("sequence_str", F.format_string("%02d%02d", "chapter_no", "section_no"))


def content_window(chunks: DataFrame, order: str = "sequence") -> DataFrame:
    """From the first heading that starts the content to before the first index after it; all of a document without such a heading."""
    h, every = F.col("heading"), Window.partitionBy("doc_id")
    starts = matches(h, P.CONTENT_START, True) | matches(h, P.CONTENT_START_NUMBER)
    marked = chunks.withColumn("_from", F.min(F.when(starts, F.col(order))).over(every))
    ends = matches(h, P.CONTENT_END, True) & (F.col(order) >= F.col("_from"))
    marked = marked.withColumn("_to", F.min(F.when(ends, F.col(order))).over(every))
    inside = F.col("_from").isNull() | ((F.col(order) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(order) < F.col("_to"))))
    return marked.where(inside).drop("_from", "_to")


def without_toc(chunks: DataFrame) -> DataFrame:
    return chunks.where("not looks_like_toc_entry")


def above_score(chunks: DataFrame, least: float = 0.0) -> DataFrame:
    return chunks.where(F.col("score") > least)


def chapter_groups(chunks: DataFrame, least: float | Column = 5.0, order: str = "sequence") -> DataFrame:
    """Adds group_no, chunk_pos, group_chapter_no and group_title; chunks before the first chapter are dropped.

    A chunk of level 3 or less whose score reaches the threshold opens a chapter; its number is its own, or one more than
    the last where it has none (0).
    """
    run = _by(order).rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("score") >= least) & (F.col("level") <= 3)
    rows = chunks.select("*", opens.alias("_open"), F.sum(opens.cast("int")).over(run).alias("group_no")).where("group_no > 0")
    rows = rows.withColumn("_given", F.when(F.col("_open") & (F.col("chapter_no") != 0), F.col("chapter_no"))).withColumn("_island", F.count("_given").over(run))
    island = Window.partitionBy("doc_id", "_island")
    counter = F.coalesce(F.max("_given").over(island), F.lit(0)) + F.sum(F.when(F.col("_open") & F.col("_given").isNull(), 1).otherwise(0)).over(
        island.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    own = Window.partitionBy("doc_id", "group_no").orderBy(order)
    rows = rows.select("*", counter.alias("_number"), (F.row_number().over(own) - 1).alias("chunk_pos"))
    rows = rows.select("*", F.first("_number").over(own).cast("int").alias("group_chapter_no"), F.first("heading").over(own).alias("group_title"))
    return rows.drop("_open", "_given", "_island", "_number")
