"""Spans of laid-out pages to profiles, scored headings with their body, and chapters, with the fallback chain.

spans: doc_id, page_no, block_no, line_no, span_no, block_type, text, size, font, flags, and optionally bbox.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.rounding import tenth
from ..functions.score import looks_like_index, looks_like_toc, score_heading
from ..functions.text import matches, strip
from .split import above_score, chapter_groups, without_toc

DEFAULT_SIZE = 12.0
ORDER = ("page_no", "block_no", "line_no", "span_no")
SHORT_PAGES = 30
#: Scores that open a chapter: first, and where nothing reaches it.
HIGH, LOW = 7.0, 3.0


def _sample(spans: DataFrame, enough: int) -> DataFrame:
    """Text spans of the pages up to the one with which there are more than `enough`."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rangeBetween(Window.unboundedPreceding, -1)
    return spans.where("block_type = 0").withColumn("before", F.count("*").over(before)).where(F.col("before") <= enough)


def together(spans: DataFrame) -> DataFrame:
    """Spans dealt by document once: grouping by page, block or line and windows by document need no other exchange."""
    return spans.repartition("doc_id")


def body_size_median(spans: DataFrame, enough: int = 200) -> DataFrame:
    """doc_id, body_size: the upper median of span sizes."""
    sizes = F.array_sort(F.collect_list("size"))
    return _sample(spans, enough).groupBy("doc_id").agg(F.element_at(sizes, (F.floor(F.count("size") / 2) + 1).cast("int")).alias("body_size"))


def body_size_mode(spans: DataFrame, enough: int = 50) -> DataFrame:
    """doc_id, body_size: the most frequent size rounded to a tenth; of equals the one seen first."""
    place = F.struct(*[F.col(c) for c in ORDER])
    sizes = _sample(spans, enough).groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    sizes = sizes.groupBy("doc_id", tenth("size").alias("body_size")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return sizes.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "body_size")


def profile(spans: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """doc_id, type, body_size (a tenth), encoding_ok, page_count, has_index, drawing_clusters. A line's end counts as a character. The last
    page is the last one with a row of any kind; a document without text has the default size."""
    cells = F.array_sort(F.collect_list(F.when(F.col("block_type") == 0, F.struct("span_no", "text"))))
    rows = together(spans).groupBy("doc_id", "page_no", "block_no", "line_no").agg(F.array_join(F.transform(cells, lambda x: x["text"]), "").alias("text"), F.max("block_type").alias("kind"), F.collect_list(F.when(F.col("block_type") == 0, F.col("size"))).alias("sizes"))
    # rows without text (images, page marks) count pages, and keep documents that have no text
    last = rows.withColumn("pages", (F.max("page_no").over(Window.partitionBy("doc_id")) + 1).cast("int"))
    # the spans of body_size_median, from the same rows
    before = Window.partitionBy("doc_id").orderBy("page_no").rangeBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("sample", F.when(F.coalesce(F.sum(F.size("sizes")).over(before), F.lit(0)) <= 200, F.col("sizes")))
    words = F.col("kind") == 0
    strange = F.regexp_count("text", F.lit("[^\\x00-\\x7F\\x{4E00}-\\x{9FFF}]"))
    early = words & (F.col("page_no") < 5)
    out = last.groupBy("doc_id").agg(
        F.max("pages").alias("page_count"),
        F.coalesce(F.sum(F.when(early, strange)), F.lit(0)).alias("strange"),
        F.coalesce(F.sum(F.when(early, F.char_length("text") + 1)), F.lit(0)).alias("chars"),
        F.bool_or(words & (F.col("page_no") >= F.col("pages") - 20) & matches(F.col("text"), "(?m)" + P.INDEX_LINE)).alias("has_index"),
        F.array_sort(F.flatten(F.collect_list("sample"))).alias("sample"),
    )
    middle = F.get("sample", F.floor(F.size("sample") / 2).cast("int"))  # null of no spans
    out = out.withColumn("body_size", middle)
    if drawings is None:
        out = out.withColumn("drawing_clusters", F.lit(0))
    else:
        counted = drawings.where("page_no < 10").groupBy("doc_id").agg(F.count("*").cast("int").alias("drawing_clusters"))
        out = out.join(counted, "doc_id", "left").fillna(0, ["drawing_clusters"])
    ok = (F.col("chars") == 0) | (F.col("strange") / F.greatest(F.col("chars"), F.lit(1)) < 0.3)
    out = out.withColumn("encoding_ok", ok)
    kind = F.when(~F.col("encoding_ok"), "cjk-broken").when(F.col("drawing_clusters") > 50, "diagram-heavy").otherwise("born-digital")
    size = F.coalesce(tenth("body_size"), F.lit(DEFAULT_SIZE))
    return out.select("doc_id", kind.alias("type"), size.alias("body_size"), "encoding_ok", "page_count", "has_index", "drawing_clusters")


def blocks(spans: DataFrame) -> DataFrame:
    """doc_id, page_no, block_no, text (a line each), size (the greatest), is_bold; blank blocks are left out."""
    bold = F.col("font").rlike("Bold|bold|Black") | (F.col("flags").bitwiseAND(2) != 0)
    cells = F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text")))
    ends = F.lit("\n")
    # a line break wherever the line changes; what follows the last line is stripped anyway
    joined = F.aggregate(
        cells,
        F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("line")),
        lambda a, x: F.struct(F.concat(a["text"], F.when(a["line"] != x["line_no"], ends).otherwise(""), x["text"]).alias("text"), x["line_no"].cast("int").alias("line")),
        lambda a: a["text"],
    )
    out = spans.where("block_type = 0").groupBy("doc_id", "page_no", "block_no").agg(strip(joined).alias("text"), F.max("size").alias("size"), F.coalesce(F.bool_or(bold), F.lit(False)).alias("is_bold"))
    return out.where("text <> ''")


def near_drawings(boxes: DataFrame, drawings: DataFrame, within: float = 20.0) -> DataFrame:
    """boxes(doc_id, page_no, block_no, bbox) that lie closer than `within` to a drawing of their page: a semi join on the page."""
    b, d = boxes.alias("b"), drawings.alias("d")
    gap_x = F.greatest(F.lit(0.0), F.col("b.bbox.x0") - F.col("d.rect.x1"), F.col("d.rect.x0") - F.col("b.bbox.x1"))
    gap_y = F.greatest(F.lit(0.0), F.col("b.bbox.y0") - F.col("d.rect.y1"), F.col("d.rect.y0") - F.col("b.bbox.y1"))
    same = (F.col("b.doc_id") == F.col("d.doc_id")) & (F.col("b.page_no") == F.col("d.page_no"))
    return b.join(d, same & (F.sqrt(gap_x * gap_x + gap_y * gap_y) < within), "left_semi")


def rich_chunks(spans: DataFrame, sizes: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Scored headings with the body blocks that follow them. sizes: doc_id, body_size.

    A block of 1.3 times the body size or more is a heading: its first line; the rest is content at levels 1 and 2 and is
    dropped at level 3. Other blocks, page numbers and running headers apart, are the body of the heading before them.
    """
    rows = blocks(together(spans)).join(sizes.select("doc_id", "body_size"), "doc_id")
    if near is None:
        rows = rows.withColumn("near_drawing", F.lit(False))
    else:
        marks = near.select("doc_id", "page_no", "block_no").distinct().withColumn("near_drawing", F.lit(True))
        rows = rows.join(marks, ["doc_id", "page_no", "block_no"], "left").fillna(False, ["near_drawing"])
    ratio = F.col("size") / F.col("body_size")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    rows = rows.select(
        "*",
        F.when(F.col("size") >= F.col("body_size") * 1.3, F.when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).otherwise(3)).alias("level"),
        first.alias("first"),
        F.struct("page_no", "block_no").alias("place"),
    )
    run = Window.partitionBy("doc_id").orderBy("page_no", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.count("level").over(run)).where("head > 0")
    rest = F.when(F.col("level") < 3, strip(F.substring(F.col("text"), F.char_length("first") + 2, F.lit(2147483647)))).otherwise("")
    body = F.col("level").isNull() & ~matches(F.col("text"), P.PAGE_NUMBER) & ~matches(F.col("text"), P.RUNNING_HEADER)
    is_head = F.col("level").isNotNull()
    piece = F.when(is_head, rest).when(body, F.col("text"))
    rows = rows.withColumn("piece", piece)
    pieces = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), lambda p: p.isNotNull() & (p != ""))

    def of_head(c):
        return F.max(F.when(is_head, c))

    out = rows.groupBy("doc_id", "head").agg(
        of_head(strip(F.regexp_replace("first", "[\\x07\\x08]", ""))).alias("heading"),
        F.array_join(pieces, "\n\n").alias("content"),
        F.max("level").alias("level"),
        of_head(F.col("size")).alias("font_size"),
        of_head(F.col("is_bold")).alias("is_bold"),
        of_head(F.col("near_drawing")).alias("near_drawing"),
        of_head(looks_like_toc(F.col("first"))).alias("looks_like_toc_entry"),
        of_head(looks_like_index(F.col("first"))).alias("looks_like_index_letter"),
        F.max("body_size").alias("body_size"),
    )
    score = score_heading(F.col("heading"), F.col("level"), F.col("font_size"), F.col("is_bold"), F.col("near_drawing"), F.col("looks_like_toc_entry"), F.col("looks_like_index_letter"), F.col("body_size"), stripped=True)
    return out.select("doc_id", (F.col("head") - 1).cast("int").alias("sequence"), "heading", "content", "level", "font_size", "is_bold", "near_drawing", "looks_like_toc_entry", "looks_like_index_letter", score.alias("score"))


def line_markdown(spans: DataFrame) -> DataFrame:
    """doc_id, markdown: each line by its size against the most frequent one, a blank line after each (the plain extraction)."""
    place = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    rows = together(spans).where("block_type = 0").groupBy("doc_id", "page_no", "block_no", "line_no").agg(strip(F.array_join(F.transform(place, lambda x: x["text"]), "")).alias("text"), F.max("size").alias("size"))
    rows = rows.where("text <> ''").join(body_size_mode(spans), "doc_id")
    ratio = F.col("size") / F.col("body_size")
    mark = F.when(ratio >= 2.0, "# ").when(ratio >= 1.6, "## ").when(ratio >= 1.3, "### ").otherwise("")
    line = F.struct("page_no", "block_no", "line_no", F.concat(mark, "text").alias("line"))
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n\n"), F.lit("\n")).alias("markdown"))


def chapters(rich: DataFrame, profiles: DataFrame, article: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """The fallback chain: rich at 7; documents without a group, of fewer than 30 pages, from `article`; then rich at 3.

    `article` has doc_id, group_no, chunk_pos, heading, content, level, group_chapter_no. mode "rich" stops after the first
    step, "article" takes the second alone; others run the chain.
    """
    cols = ["doc_id", "route", "group_no", "chunk_pos", "group_chapter_no", "group_title", "heading", "content", "level"]
    kinds = {"group_no": "int", "chunk_pos": "int", "group_chapter_no": "int", "level": "int"}

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in cols])

    plain = None if article is None else shaped(article.withColumn("group_title", F.col("heading")).withColumn("route", F.lit("article")))
    if mode == "article":
        if plain is None:
            raise ValueError("mode article needs article chunks")
        return plain
    every = Window.partitionBy("doc_id")
    kept = above_score(without_toc(rich), -1.0).withColumn("chapter_no", F.lit(0))
    if mode == "rich":
        return shaped(chapter_groups(kept, HIGH).withColumn("route", F.lit("rich")))
    # one pass: a document with a heading that reaches the high mark is grouped by it, others by the low one
    kept = kept.withColumn("high", F.max((F.col("score") >= HIGH) & (F.col("level") <= 3)).over(every))
    out = chapter_groups(kept, F.when(F.col("high"), HIGH).otherwise(LOW))
    out = shaped(out.withColumn("route", F.when(F.col("high"), "rich").otherwise("lowscore")))
    if plain is None:
        return out
    short = profiles.where(F.col("page_count") < SHORT_PAGES).select("doc_id")
    both = out.unionByName(plain.join(short, "doc_id", "left_semi"))
    rank = F.when(F.col("route") == "rich", 0).when(F.col("route") == "article", 1).otherwise(2)
    return both.withColumn("rank", rank).withColumn("best", F.min("rank").over(every)).where("rank = best").drop("rank", "best")
