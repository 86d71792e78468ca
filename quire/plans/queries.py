"""Queries of the structuring operators over whole tables, and their SQL."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.score import looks_like_index, looks_like_toc, score_heading
from ..operators import article as A
from ..operators import meta as M
from ..operators import pdf, render, split
from ..sinks.tree import read_tree, rendered, unique_ids, write_tree
from ..sources import auto, epub, fb2, vocabulary
from ..sources.html_md import markdown_of
from ..sources.registry import format_of, stem_of
from . import views as V
from .views import ARTICLE, LINES, MARKDOWN, SPANS, m, n, slug, strip, x

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


ROWS = "rows between unbounded preceding and current row"

# ---------------------------------------------------------------- markdown

SPLIT = f"""{MARKDOWN},
m1 as (select *, length({x("line", P.MD_HEADING, 1)}) as level, {x("line", P.MD_HEADING, 2)} as title from md),
m2 as (select *, coalesce(level = 1 and {m("title", P.PART, True)}, false) as is_part from m1),
m3 as (select *, sum(case when level is not null then 1 else 0 end) over w as chunk,
         last_value(case when is_part then title end ignore nulls) over w as part
       from m2 where level is null or level > 1 or is_part window w as (partition by doc_id order by pos {ROWS})),
m4 as (select doc_id, chunk, max(case when level > 1 then title end) as heading, max(case when level > 1 then level end) as level,
         {strip("coalesce(string_agg(case when level is null then line end, chr(10) order by pos), '')")} as content, coalesce(max(part), '') as part
       from m3 group by doc_id, chunk),
chunks as (select doc_id, cast(row_number() over (partition by doc_id order by chunk) - 1 as int) as sequence, heading, content, cast(level as int) as level, part
       from m4 where heading is not null and content <> '')"""
ENRICH = f"""{SPLIT},
e1 as (select *, level <= 2 as opens,
    case when level <= 2 then coalesce({n("heading", P.H2_NUM, 1, True)}, {n("heading", P.H2_NUM, 2, True)}) end as num,
    case when level = 3 then {n("heading", P.H3_DOTTED, 1, True)} end as over_no,
    case when level = 3 then coalesce({n("heading", P.H3_DOTTED, 2, True)}, {n("heading", P.H3_WORD, 1, True)}, {n("heading", P.H3_PLAIN, 1)}) end as sec from chunks),
e2 as (select *, count(num) over w as island, sum(case when opens then 1 else 0 end) over w as ord,
    coalesce(last_value(nullif(part, '') ignore nulls) over w, '') as part_now from e1 window w as (partition by doc_id order by sequence {ROWS})),
e3 as (select *, coalesce(max(num) over (partition by doc_id, island), 0)
      + sum(case when opens and num is null then 1 else 0 end) over (partition by doc_id, island order by sequence {ROWS}) as counter,
    last_value(over_no ignore nulls) over w as over_now, first_value(heading) over w as first_heading,
    sum(case when level = 3 and sec is null then 1 else 0 end) over w as counted from e2 window w as (partition by doc_id, ord order by sequence {ROWS})),
e4 as (select doc_id, sequence, heading, content, level, part_now as part, cast(coalesce(over_now, counter) as int) as chapter_no,
    case when ord > 0 then first_heading else '' end as chapter_title,
    cast(case when level = 3 then coalesce(sec, counted) else 0 end as int) as section_no, case when level = 3 then heading else '' end as section_title from e3),
enriched as (select *, printf('%02d%02d', chapter_no, section_no) as sequence_str from e4)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_markdown(V.markdown_lines(spark, sf_dir))


@query(f"with {SPLIT} select * from chunks")
def md_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query(f"with {ENRICH} select * from enriched")
def md_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.enrich(_chunks(spark, sf_dir))


@query(
    f"""with {ENRICH} select doc_id, chapter_no, chapter_title, cast(sum(case when level = 3 then 1 else 0 end) as bigint) as sections,
    cast(sum(length(content)) as bigint) as chars from enriched group by all"""
)
def md_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.enrich(_chunks(spark, sf_dir))
    return rows.groupBy("doc_id", "chapter_no", "chapter_title").agg(
        F.sum((F.col("level") == 3).cast("int")).alias("sections"), F.sum(F.char_length("content").cast("long")).alias("chars")
    )


@query(f"with {ENRICH} select doc_id, part, min(sequence) as first_chunk, count(*) as chunks from enriched group by all")
def md_part_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.enrich(_chunks(spark, sf_dir)).groupBy("doc_id", "part").agg(F.min("sequence").alias("first_chunk"), F.count("*").alias("chunks"))


@query(
    f"""with {SPLIT},
    c1 as (select *, min(case when {m("heading", P.CONTENT_START, True)} or {m("heading", P.CONTENT_START_NUMBER)} then sequence end) over (partition by doc_id) as lo from chunks),
    c2 as (select *, min(case when {m("heading", P.CONTENT_END, True)} and sequence >= lo then sequence end) over (partition by doc_id) as hi from c1)
    select doc_id, sequence, heading, content, level, part from c2 where lo is null or (sequence >= lo and (hi is null or sequence < hi))"""
)
def md_content_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.content_window(_chunks(spark, sf_dir))


# ---------------------------------------------------------------- spans


def score_sql(heading: str, level: str, size: str, bold: str, toc: str, index: str, body: str) -> str:
    h = strip(heading)
    return f"""case when {h} = '' then 0.0 else
      (case when length({h}) < 4 then -5.0 else 0 end) + (case when {m(h, P.TOC_END)} then -8 else 0 end) + (case when {m(h, P.TOC_START)} then -8 else 0 end)
      + (case when {m(h, P.INDEX_LETTER)} and {level} >= 2 then -8 else 0 end) + (case when {m(h, P.NONWORD)} then -10 else 0 end)
      + (case when {m(h, P.KEYWORD, True)} then 6 else 0 end) + (case when {m(h, P.NUMBERED)} then 5 else 0 end)
      + (case when {size} >= {body} * 2.0 then 5 when {size} >= {body} * 1.6 then 3 when {size} >= {body} * 1.18 then 1 else 0 end)
      + (case when {bold} then 1 else 0 end) + (case when {toc} then -10 else 0 end) + (case when {index} then -8 else 0 end) end"""


TOC = f"({m('text', P.TOC_END)} or {m('text', P.TOC_START)})"
INDEX = m("text", P.INDEX_LETTER)
LEVEL = "case when size / 11.0 >= 2.0 then 1 when size / 11.0 >= 1.6 then 2 else 3 end"


@query(
    f"""with {SPANS} select doc_id, block_no, cast({score_sql("text", "(" + LEVEL + ")", "size", "font = 'Serif-Bold'", TOC, INDEX, "11.0")} as double) as score from spans"""
)
def heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, size, body = F.col("text"), F.col("size"), F.lit(11.0)
    level = F.when(size / 11.0 >= 2.0, 1).when(size / 11.0 >= 1.6, 2).otherwise(3)
    score = score_heading(F.col("heading"), level, size, F.col("font") == "Serif-Bold", F.lit(False), looks_like_toc(t), looks_like_index(t), body, stripped=True)
    return V.spans(spark, sf_dir).withColumn("heading", T.strip(t)).select("doc_id", "block_no", score.alias("score"))


SAMPLE = """pages as (select doc_id, page_no, count(*) as n from spans group by all),
before as (select doc_id, page_no, coalesce(sum(n) over (partition by doc_id order by page_no rows between unbounded preceding and 1 preceding), 0) as b from pages)"""
MEDIAN = f"""{SAMPLE},
sizes as (select s.doc_id, list_sort(list(size)) as v from spans s join before p on s.doc_id = p.doc_id and s.page_no = p.page_no and b <= 200 group by s.doc_id),
body as (select doc_id, v[len(v) // 2 + 1] as body_size from sizes)"""


@query(f"with {SPANS}, {MEDIAN} select * from body")
def body_size_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.body_size_median(V.spans(spark, sf_dir))


@query(
    f"""with {SPANS}, {SAMPLE},
    c as (select s.doc_id, round(size, 1) as body_size, count(*) as k, min(block_no) as f from spans s join before p on s.doc_id = p.doc_id and s.page_no = p.page_no and b <= 50 group by all)
    select doc_id, body_size from (select *, row_number() over (partition by doc_id order by k desc, f) as r from c) where r = 1"""
)
def body_size_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.body_size_mode(V.spans(spark, sf_dir))


PROFILE = f"""{MEDIAN},
pc as (select doc_id, max(page_no) + 1 as page_count from spans group by doc_id),
pr as (select s.doc_id, any_value(page_count) as page_count,
    sum(case when page_no < 5 then len(regexp_extract_all(text, '[^\\x00-\\x7F\\x{{4E00}}-\\x{{9FFF}}]')) else 0 end) as strange,
    sum(case when page_no < 5 then length(text) + 1 else 0 end) as chars, bool_or(page_no >= page_count - 20 and {m("text", P.INDEX_LINE)}) as has_index
    from spans s join pc on s.doc_id = pc.doc_id group by s.doc_id),
profiles as (select pr.doc_id, case when not (chars = 0 or strange / greatest(chars, 1) < 0.3) then 'cjk-broken' else 'born-digital' end as type, round(body_size, 1) as body_size,
    chars = 0 or strange / greatest(chars, 1) < 0.3 as encoding_ok, cast(page_count as int) as page_count, has_index, cast(0 as int) as drawing_clusters from pr join body on pr.doc_id = body.doc_id)"""


@query(f"with {SPANS}, {PROFILE} select * from profiles")
def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.profile(V.spans(spark, sf_dir))


BLOCKS = f"blocks as (select doc_id, page_no, block_no, {strip('text')} as text, size, font = 'Serif-Bold' as is_bold from spans where {strip('text')} <> '')"


@query(f"with {SPANS}, {BLOCKS} select * from blocks")
def rich_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.blocks(V.spans(spark, sf_dir))


RICH = f"""{PROFILE}, {BLOCKS},
b1 as (select b.*, p.body_size, case when size >= p.body_size * 1.3 then case when size / p.body_size >= 2.0 then 1 when size / p.body_size >= 1.6 then 2 else 3 end end as level
    from blocks b join profiles p on b.doc_id = p.doc_id),
b2 as (select *, count(level) over (partition by doc_id order by page_no, block_no {ROWS}) as head from b1),
b3 as (select doc_id, head, max(case when level is not null then text end) as heading,
    coalesce(string_agg(case when level is null and not {m("text", P.PAGE_NUMBER)} and not {m("text", P.RUNNING_HEADER)} then text end, chr(10) || chr(10) order by page_no, block_no), '') as content,
    max(level) as level, max(case when level is not null then size end) as font_size, bool_or(level is not null and is_bold) as is_bold, max(body_size) as body_size
    from b2 where head > 0 group by doc_id, head),
rich as (select doc_id, cast(head - 1 as int) as sequence, heading, content, cast(level as int) as level, font_size, is_bold, false as near_drawing,
    {TOC.replace("text", "heading")} as looks_like_toc_entry, {INDEX.replace("text", "heading")} as looks_like_index_letter,
    cast({score_sql("heading", "level", "font_size", "is_bold", TOC.replace("text", "heading"), INDEX.replace("text", "heading"), "body_size")} as double) as score from b3)"""


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.spans(spark, sf_dir)
    return pdf.rich_chunks(s, pdf.profile(s))


@query(f"with {SPANS}, {RICH} select * from rich")
def body_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rich(spark, sf_dir)


@query(f"with {SPANS}, {RICH} select * from rich where not looks_like_toc_entry")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.without_toc(_rich(spark, sf_dir))


@query(f"with {SPANS}, {RICH} select * from rich where score > -1.0")
def low_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.above_score(_rich(spark, sf_dir), -1.0)


def groups_sql(source: str, least: float, number: str = "0") -> str:
    return f"""g1 as (select *, {number} as own_no, score >= {least} and level <= 3 as opens from {source}),
g2 as (select * from (select *, sum(case when opens then 1 else 0 end) over (partition by doc_id order by sequence {ROWS}) as group_no from g1) where group_no > 0),
g3 as (select *, count(case when opens and own_no <> 0 then own_no end) over (partition by doc_id order by sequence {ROWS}) as island from g2),
g4 as (select *, coalesce(max(case when opens and own_no <> 0 then own_no end) over (partition by doc_id, island), 0)
    + sum(case when opens and own_no = 0 then 1 else 0 end) over (partition by doc_id, island order by sequence {ROWS}) as number from g3),
grouped as (select *, cast(row_number() over (partition by doc_id, group_no order by sequence) - 1 as int) as chunk_pos,
    cast(first_value(number) over (partition by doc_id, group_no order by sequence) as int) as group_chapter_no, first_value(heading) over (partition by doc_id, group_no order by sequence) as group_title from g4)"""


@query(
    f"""with {SPANS}, {RICH}, {groups_sql("rich", 7.0)}
    select doc_id, sequence, heading, cast(group_no as bigint) as group_no, chunk_pos, group_chapter_no, group_title from grouped"""
)
def chapter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.chapter_groups(_rich(spark, sf_dir).withColumn("chapter_no", F.lit(0)), 7.0)
    return rows.select("doc_id", "sequence", "heading", "group_no", "chunk_pos", "group_chapter_no", "group_title")


@query(
    f"""with {ENRICH}, scored as (select *, cast(case when level = 2 then 6 else case when sequence % 5 = 0 then 6 else 1 end end as double) as score, case when sequence % 3 = 0 then 0 else chapter_no end as given from enriched),
    {groups_sql("scored", 5.0, "given")} select doc_id, sequence, heading, cast(group_no as bigint) as group_no, chunk_pos, group_chapter_no from grouped"""
)
def numbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.enrich(_chunks(spark, sf_dir))
    score = F.when((F.col("level") == 2) | (F.col("sequence") % 5 == 0), 6.0).otherwise(1.0)
    rows = rows.withColumn("score", score).withColumn("chapter_no", F.when(F.col("sequence") % 3 == 0, 0).otherwise(F.col("chapter_no")))
    return split.chapter_groups(rows, 5.0).select("doc_id", "sequence", "heading", "group_no", "chunk_pos", "group_chapter_no")


@query(
    f"""with {LINES}, boxes as (select doc_id, cast(pos // 4 as int) as page_no, pos as block_no, cast(72 as double) as x0, cast(pos % 4 * 150 as double) as y0, cast(300 as double) as x1, cast(pos % 4 * 150 + 14 as double) as y1 from lines),
    drawn as (select doc_id, page_no, cast(310 as double) as x0, cast(doc_id % 4 * 150 + 20 as double) as y0, cast(400 as double) as x1, cast(doc_id % 4 * 150 + 60 as double) as y1 from (select distinct doc_id, page_no from boxes) where page_no % 2 = 0)
    select doc_id, page_no, block_no from boxes b where exists (select 1 from drawn d where d.doc_id = b.doc_id and d.page_no = b.page_no
      and sqrt(power(greatest(0, b.x0 - d.x1, d.x0 - b.x1), 2) + power(greatest(0, b.y0 - d.y1, d.y0 - b.y1), 2)) < 20)"""
)
def drawing_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    top = (pos % 4 * 150).cast("double")
    boxes = V.doc_lines(spark, sf_dir).select(
        "doc_id", F.floor(pos / 4).cast("int").alias("page_no"), pos.alias("block_no"), F.struct(F.lit(72.0).alias("x0"), top.alias("y0"), F.lit(300.0).alias("x1"), (top + 14.0).alias("y1")).alias("bbox")
    )
    low = (F.col("doc_id") % 4 * 150 + 20).cast("double")
    drawn = boxes.select("doc_id", "page_no").distinct().where("page_no % 2 = 0")
    drawn = drawn.select("doc_id", "page_no", F.struct(F.lit(310.0).alias("x0"), low.alias("y0"), F.lit(400.0).alias("x1"), (low + 40.0).alias("y1")).alias("rect"))
    return pdf.near_drawings(boxes, drawn).select("doc_id", "page_no", "block_no")


@query(
    f"""with {SPANS}, {SAMPLE},
    c as (select s.doc_id, round(size, 1) as v, count(*) as k, min(block_no) as f from spans s join before p on s.doc_id = p.doc_id and s.page_no = p.page_no and b <= 50 group by all),
    mode as (select doc_id, v from (select *, row_number() over (partition by doc_id order by k desc, f) as r from c) where r = 1),
    {BLOCKS} select b.doc_id, string_agg(case when size / v >= 2.0 then '# ' when size / v >= 1.6 then '## ' when size / v >= 1.3 then '### ' else '' end || text, chr(10) || chr(10) order by block_no) || chr(10) as markdown
    from blocks b join mode on b.doc_id = mode.doc_id group by b.doc_id"""
)
def line_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.line_markdown(V.spans(spark, sf_dir))


# ---------------------------------------------------------------- articles

KEPT = f"""{ARTICLE}, kept as (select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as int) as pos, line
  from (select doc_id, pos, {strip("line")} as line from raw) where line <> '' and not {m("line", P.JUNK, True)})"""
STARTS = ", ".join(f"'{w}'" for w in P.BODY_STARTS)
HEADS = f"""{KEPT},
h1 as (select *, case when length(line) <= 40 and ((upper(line) = line and lower(line) <> line and {m("line", P.ACADEMIC_LINE)}) or {m("line", P.CHAPTER_WORD, True)} or {m("line", P.APPENDIX_WORD, True)})
      then regexp_replace(line, ':+$', '')
    when count(*) over (partition by doc_id) < 500 and length(line) <= 100 and {m("line", P.ARTICLE_NUMBERED)}
      and lower(regexp_extract({strip(x("line", P.ARTICLE_NUMBERED, 2))}, '^[^\\s\\pZ]+', 0)) not in ({STARTS}) then line end as found from kept),
h2 as (select *, last_value(found ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as earlier from h1),
heads as (select doc_id, pos, line, case when found is not null and (earlier is null or lower(found) <> lower(earlier)) then found end as heading from h2)"""


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.strip_junk(V.article_lines(spark, sf_dir))


@query(f"with {KEPT} select * from kept")
def article_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir)


@query(f"with {HEADS} select doc_id, pos, heading from heads where heading is not null")
def article_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.headings(_plain(spark, sf_dir)).where("heading is not null").select("doc_id", "pos", "heading")


SECTIONS = f"""{HEADS}, s1 as (select *, count(heading) over (partition by doc_id order by pos {ROWS}) as sec from heads),
s2 as (select doc_id, sec, max(heading) as heading, {strip("coalesce(string_agg(case when heading is null then line end, chr(10) order by pos), '')")} as content from s1 group by doc_id, sec),
s3 as (select *, max(sec) over (partition by doc_id) as last_sec, max(case when sec = 0 then 1 else 0 end) over (partition by doc_id) as front from s2),
sections as (select doc_id, cast(case when last_sec = 0 then 1 else sec + front end as int) as group_no, cast(0 as int) as chunk_pos,
    case when last_sec = 0 then cast(doc_id as varchar) when sec = 0 then 'Front Matter' else heading end as heading, content, cast(2 as int) as level,
    cast(case when last_sec = 0 or sec = 0 then 1 when front = 0 and sec = 1 then 1 else sec + 1 end as int) as group_chapter_no from s3)"""


@query(f"with {SECTIONS} select * from sections")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sections(A.headings(_plain(spark, sf_dir)))


STOPS = " or ".join(f"contains(lower(line), '{s}')" for s in P.TITLE_STOPS)


@query(
    f"""with {KEPT}, t1 as (select *, {m("line", P.PERSON)} or (length(line) < 10 and pos > 0) or {STOPS} as stop from kept where pos < 20),
    t2 as (select *, min(case when stop then pos end) over (partition by doc_id) as e from t1)
    select doc_id, nullif({strip("coalesce(string_agg(case when e is null or pos < e then line end, ' ' order by pos), '')")}, '') as title from t2 group by doc_id"""
)
def article_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.title(_plain(spark, sf_dir))


@query(
    f"""with {SPANS}, {RICH}, {groups_sql("(select * from rich where not looks_like_toc_entry and score > -1.0)", 7.0)},
    first as (select doc_id, 'rich' as route, group_no, chunk_pos, group_chapter_no, group_title, heading, content, level from grouped),
    {", ".join(p for p in [SECTIONS.split(LINES + ", ")[1]])},
    second as (select s.doc_id, 'article' as route, group_no, chunk_pos, group_chapter_no, heading as group_title, heading, content, level from sections s join profiles p on s.doc_id = p.doc_id and page_count < 30
      where s.doc_id not in (select doc_id from first)),
    {groups_sql("(select * from rich where not looks_like_toc_entry and score > -1.0 and doc_id not in (select doc_id from first) and doc_id not in (select doc_id from second))", 3.0).replace("g1", "q1").replace("g2", "q2").replace("g3", "q3").replace("g4", "q4").replace("grouped", "regrouped")}
    select doc_id, route, cast(group_no as int) as group_no, chunk_pos, group_chapter_no, group_title, heading, content, level from first
    union all select doc_id, route, group_no, chunk_pos, group_chapter_no, group_title, heading, content, level from second
    union all select doc_id, 'lowscore', cast(group_no as int), chunk_pos, group_chapter_no, group_title, heading, content, level from regrouped"""
)
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.spans(spark, sf_dir)
    profiles = pdf.profile(s)
    return pdf.chapters(pdf.rich_chunks(s, profiles), profiles, A.sections(A.headings(_plain(spark, sf_dir))))


# ---------------------------------------------------------------- scalars and metadata


@query(f"select doc_id, {slug('text')} as slug from documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(f"select doc_id, coalesce(nullif(substr({slug('text')}, 1, 60), ''), 'untitled') as slug from documents")
def file_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.file_slug(F.col("text")).alias("slug"))


FIRST = f"list_filter(list_transform(string_split(content, chr(10)), lambda z: {strip('z')}), lambda z: z <> '')[1]"
TITLE = f"case when {m('h', P.BARE_CHAPTER, True)} and length({FIRST}) <= 80 then {FIRST} else h end"


@query(f"select doc_id, {TITLE} as title from (select doc_id, case when doc_id % 3 = 0 then 'CHAPTER ' || doc_id else 'Глава о ' || doc_id end as h, text as content from documents)")
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CHAPTER "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("Глава о "), F.col("doc_id").cast("string")))
    return V.table(spark, sf_dir, "documents").select("doc_id", T.chapter_title(h, F.col("text")).alias("title"))


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda z: {slug('z')}), lambda z: z <> ''), ',') as topics from documents")
def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.topics(F.split("text", " ")), ",").alias("topics"))


AUTHOR = "case doc_id % 4 when 0 then 'Doe, ' || lang || ' ; Smith,  John;' when 1 then source when 2 then 'A, B, C; ' || lang else '' end"
NAMES = f"list_filter(list_transform(string_split(p, ','), lambda z: {strip('z')}), lambda z: z <> '')"


@query(
    f"""with a as (select doc_id, list_filter(list_transform(string_split({AUTHOR}, ';'), lambda z: {strip("z")}), lambda z: z <> '') as parts from documents)
    select doc_id, array_to_string(list_transform(parts, lambda p: case when contains(p, ',') and len({NAMES}) = 2 then {NAMES}[2] || ' ' || {NAMES}[1] else p end), '|') as authors from a"""
)
def pdf_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    author = F.when(k == 0, F.concat(F.lit("Doe, "), "lang", F.lit(" ; Smith,  John;"))).when(k == 1, F.col("source")).when(k == 2, F.concat(F.lit("A, B, C; "), "lang")).otherwise("")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.split_pdf_authors(author), "|").alias("authors"))


CREATORS = "lang || case when doc_id % 2 = 0 then ' and ' || source else ' ' end"


@query(
    f"""select doc_id, array_to_string(case when contains(c, ' and ') then list_filter(list_transform(string_split(c, ' and '), lambda z: {strip("z")}), lambda z: z <> '') else [{strip("c")}] end, '|') as authors
    from (select doc_id, {CREATORS} as c from documents)"""
)
def epub_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" and "), "source")).otherwise(" "))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.split_epub_author(c), "|").alias("authors"))


@query(
    """select event_id, try_cast(nullif(regexp_extract('D:' || strftime(ts, '%Y%m%d') || 'Z', 'D:([0-9]{4})', 1), '') as int) as pdf_year,
    try_cast(nullif(regexp_extract(strftime(ts, '%d.%m.%Y'), '(20[0-9]{2})', 1), '') as int) as article_year from events"""
)
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "events")
    return rows.select("event_id", M.pdf_year(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMdd"), F.lit("Z"))).alias("pdf_year"), M.first_year(F.date_format("ts", "dd.MM.yyyy"), "(20[0-9]{2})").alias("article_year"))


DOMAINS = [f"src{i}" for i in range(0, 15)]


@query(
    f"""select doc_id, domain from (select doc_id, unnest(case when doc_id % 10 = 0 then cast([null] as varchar[]) else [source, lang] end) as domain from documents)
    where domain is null or domain not in ({", ".join(f"'{d}'" for d in DOMAINS)})"""
)
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spark.createDataFrame([("tech-lib", d) for d in DOMAINS] + [("other", "en")], "collection string, domain string")
    given = V.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang")).alias("domains"))
    return M.unknown_domains(given, vocabulary, "tech-lib")


@query(
    """select page_id, coalesce(case when page_id % 3 = 0 then 'epub' end, lower(regexp_extract(p, '\\.([^./]+)$', 1))) as format, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem
    from (select page_id, url || case when page_id % 2 = 0 then '/Book.v2.PDF' else '/x.fb2' end as p from pages)"""
)
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/Book.v2.PDF").otherwise("/x.fb2"))
    return V.table(spark, sf_dir, "pages").select("page_id", format_of(path, F.when(F.col("page_id") % 3 == 0, "EPUB")).alias("format"), stem_of(path).alias("stem"))


def quote_sql(s: str) -> str:
    return f"""case when {s} = '' then '''''' when regexp_matches({s}, '^[{{\\[''"&*!|>%@`]') or lower({s}) in ('true', 'false', 'null', 'yes', 'no', 'on', 'off')
      or regexp_matches({s}, '[:#{{}}\\[\\],&*?|<>=!%@`'']') or {strip(s)} <> {s} or starts_with({s}, '- ') then '''' || replace({s}, '''', '''''') || '''' else {s} end"""


@query(f"with {LINES} select doc_id, pos, {quote_sql('line')} as quoted from lines")
def yaml_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.doc_lines(spark, sf_dir).select("doc_id", "pos", T.yaml_text(F.col("line")).alias("quoted"))


NEW = "chr(10)"
BOOK = f"""book as (select doc_id, string_split(text, chr(10))[1] as title, [source, lang || ': x'] as authors, [source] as domains, [lang] as topics, case when doc_id % 2 = 0 then 'en' else '' end as language,
  case when doc_id % 3 = 0 then null else cast(2000 + doc_id % 30 as int) end as year from documents),
card as (select doc_id, {slug("coalesce(nullif(title, ''), 'untitled')")} as id, coalesce(nullif(title, ''), 'untitled') as title, authors, domains, list_filter(list_transform(topics, lambda z: {slug("z")}), lambda z: z <> '') as topics,
  coalesce(nullif(language, ''), 'en') as language, year from book)"""


def _list_sql(name: str) -> str:
    return f"'{name}:' || array_to_string(list_transform({name}, lambda z: {NEW} || '  - ' || {quote_sql('z')}), '')"


@query(
    f"""with {BOOK} select doc_id, '---' || {NEW} || array_to_string(['id: ' || {quote_sql("id")}, 'title: ' || {quote_sql("title")}, {_list_sql("authors")}, {_list_sql("domains")}, {_list_sql("topics")},
      'book_type: technical', 'source_format: null', 'language: ' || language, 'year: ' || coalesce(cast(year as varchar), 'null'), 'edition: null', 'status: unread', 'priority: high'], {NEW}) || {NEW} || '---' || {NEW} as card from card"""
)
def book_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.book_card(_books(spark, sf_dir))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.array("source", F.concat("lang", F.lit(": x"))).alias("authors"), F.array("source").alias("domains"), F.array("lang").alias("topics"),
        F.when(F.col("doc_id") % 2 == 0, "en").otherwise("").alias("language"), F.when(F.col("doc_id") % 3 != 0, (2000 + F.col("doc_id") % 30).cast("int")).alias("year"),
    )
    return M.normalize(raw)


@query(
    f"""with {SPANS}, {RICH}, {groups_sql("rich", 7.0)}, {BOOK},
    f1 as (select doc_id, group_no, chunk_pos, group_chapter_no, case when chunk_pos = 0 then nullif(content, '')
        else nullif(concat_ws({NEW} || {NEW}, case when heading <> '' then repeat('#', cast(least(greatest(level, 2), 6) as int)) || ' ' || heading end, nullif(content, '')), '') end as section,
        case when chunk_pos = 0 then {TITLE.replace("(h,", "(" + strip("heading") + ",").replace("else h end", "else " + strip("heading") + " end")} end as title from grouped),
    f2 as (select doc_id, group_no, max(title) as title, max(group_chapter_no) as number, coalesce(string_agg(section, {NEW} || {NEW} order by chunk_pos), '') as body from f1 group by doc_id, group_no)
    select f2.doc_id, cast(group_no as int) as group_no, id || '/' || printf('%02d', group_no) || '-' || coalesce(nullif(substr({slug("f2.title")}, 1, 60), ''), 'untitled') || '.md' as path,
      concat_ws({NEW} || {NEW}, '---' || {NEW} || 'book_id: ' || {quote_sql("id")} || {NEW} || 'chapter_no: ' || number || {NEW} || 'chapter_title: ' || {quote_sql("f2.title")} || {NEW} || 'sequence: ' || group_no || {NEW} || '---', nullif(body, '')) || {NEW} as body
    from f2 join card on f2.doc_id = card.doc_id"""
)
def chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.chapter_groups(_rich(spark, sf_dir).withColumn("chapter_no", F.lit(0)), 7.0)
    return render.chapter_files(rows, _books(spark, sf_dir))


@query(
    f"""with {SPANS}, {RICH}, {groups_sql("rich", 7.0)} select doc_id, cast(group_no as bigint) as group_no, chunk_pos, '[' || printf('%02d', sequence + 1) || '] ' || heading as label,
    replace(substr(content, 1, 80), chr(10), ' ') as preview from grouped"""
)
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.dry_run(split.chapter_groups(_rich(spark, sf_dir).withColumn("chapter_no", F.lit(0)), 7.0))


# ---------------------------------------------------------------- structural sources

EPUB_SQL = """items as (select page_id // 5 as doc_id, 'i' || page_id as item_id, 'p' || (page_id % 7) || '-' || (page_id // 5) || '.html' as href,
    case when page_id % 6 = 5 then 'image/png' else 'application/xhtml+xml' end as media_type from pages),
  toc as (select page_id // 5 as doc_id, cast(page_id % 5 as int) as ord, url as title, case when page_id % 9 = 4 then '' else 'p' || ((page_id // 2 * 2) % 7) || '-' || (page_id // 5) || '.html#s' || page_id end as href from pages where (page_id // 5) % 3 <> 0),
  spine as (select page_id // 5 as doc_id, cast(4 - page_id % 5 as int) as ord, 'i' || page_id as item_id from pages)"""


def _epub(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, page, doc = V.table(spark, sf_dir, "pages"), F.col("page_id"), F.floor(F.col("page_id") / 5)
    s = lambda c: c.cast("string")
    items = p.select(doc.alias("doc_id"), F.concat(F.lit("i"), s(page)).alias("item_id"), F.concat(F.lit("p"), s(page % 7), F.lit("-"), s(doc), F.lit(".html")).alias("href"),
                     F.when(page % 6 == 5, "image/png").otherwise("application/xhtml+xml").alias("media_type"))
    href = F.concat(F.lit("p"), s(F.floor(page / 2) * 2 % 7), F.lit("-"), s(doc), F.lit(".html#s"), s(page))
    toc = p.where(doc % 3 != 0).select(doc.alias("doc_id"), (page % 5).cast("int").alias("ord"), F.col("url").alias("title"), F.when(page % 9 == 4, "").otherwise(href).alias("href"))
    spine = p.select(doc.alias("doc_id"), (4 - page % 5).cast("int").alias("ord"), F.concat(F.lit("i"), s(page)).alias("item_id"))
    return items, toc, spine


@query(
    f"""with {EPUB_SQL}, t1 as (select doc_id, ord, title, split_part(href, '#', 1) as href from toc where href <> ''),
    t2 as (select * from (select *, row_number() over (partition by doc_id, href order by ord) as r from t1) where r = 1)
    select t2.doc_id, t2.href, ord, title as toc_title, item_id, media_type, cast(row_number() over (partition by t2.doc_id order by ord) as int) as chapter_no from t2 join items i on t2.doc_id = i.doc_id and t2.href = i.href"""
)
def toc_dedup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, toc, _ = _epub(spark, sf_dir)
    return epub.toc_documents(toc, items)


@query(
    f"""with {EPUB_SQL} select s.doc_id, s.item_id, ord, href, media_type, '' as toc_title, cast(row_number() over (partition by s.doc_id order by ord) as int) as chapter_no
    from spine s join items i on s.doc_id = i.doc_id and s.item_id = i.item_id where contains(media_type, 'html') and s.doc_id not in (select doc_id from toc where href <> '')"""
)
def spine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, toc, spine = _epub(spark, sf_dir)
    return epub.spine_documents(spine, items, toc)


@query(
    f"""with {MARKDOWN}, p1 as (select doc_id, pos, line, length({x("line", P.MD_HEADING, 1)}) as lvl, {strip(x("line", P.MD_HEADING, 2))} as name from md),
    p2 as (select *, count(lvl) over w as sec, coalesce(last_value(lvl ignore nulls) over w > 1, false) as in_sec from p1 window w as (partition by doc_id order by pos {ROWS})),
    p3 as (select doc_id, case when in_sec then sec else 0 end as place, arg_min(name, pos) filter (lvl = 1) as first, max(case when lvl > 1 then name end) as heading, max(case when lvl > 1 then least(lvl, 3) end) as level,
      {strip("coalesce(string_agg(case when lvl is null then line end, chr(10) order by pos), '')")} as content from p2 group by all),
    docs as (select doc_id, case when doc_id % 2 = 0 then source else '' end as toc_title from documents),
    p4 as (select d.doc_id, 0 as place, coalesce(nullif({strip("toc_title")}, ''), nullif(first, ''), 'Chapter 1') as heading, 1 as level, coalesce(content, '') as content from docs d left join (select * from p3 where place = 0) p on d.doc_id = p.doc_id
      union all select doc_id, place, heading, level, content from p3 where place > 0)
    select doc_id, cast(1 as int) as group_no, cast(row_number() over (partition by doc_id order by place) - 1 as int) as chunk_pos, heading, cast(level as int) as level, content, cast(1 as int) as group_chapter_no from p4"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("pos", "line")))
    text = V.markdown_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(cells, lambda c: c["line"]), "\n").alias("markdown"))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("toc_title"))
    return epub.chapter_chunks(docs.join(text, "doc_id").select("doc_id", F.lit(1).alias("chapter_no"), "toc_title", "markdown"))


@query()
def html_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", markdown_of(F.col("html")).alias("markdown"))


@query()
def html_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("chapter_no"), F.lit("").alias("toc_title"), markdown_of(F.col("html")).alias("markdown"))
    return epub.chapter_chunks(pages)


def _fb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An FB2 file of each document: a section a line, each with one inside."""
    def safe(c):
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(mark), F.lit(entity))
        return c

    plain = F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    section = lambda x: F.concat(F.lit("<section><title><p>"), safe(F.substring(x, 1, 20)), F.lit("</p></title><p>"), safe(x), F.lit("</p><section><p>x <emphasis>e</emphasis> y</p></section></section>"))
    body = F.array_join(F.transform(F.split(plain, "\n", -1), section), "")
    head = '<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>'
    xml = F.concat(F.lit(head), "lang", F.lit("</book-title><lang>de</lang><date>May 2021</date></title-info></description><body>"), body, F.lit("</body></FictionBook>"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("books/"), F.col("doc_id").cast("string"), F.lit(".fb2")).alias("path"), xml.cast("binary").alias("content"))


@query(
    f"""with {LINES}, l as (select doc_id, pos, regexp_replace(line, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') as line from lines)
    select cast(doc_id as varchar) as doc_id, cast(pos + 1 as int) as group_no, cast(0 as int) as chunk_pos, cast(1 as int) as level, coalesce(nullif({strip("substr(line, 1, 20)")}, ''), 'Chapter ' || (pos + 1)) as heading, {strip("line")} as content, cast(pos + 1 as int) as group_chapter_no from l
    union all select cast(doc_id as varchar), cast(pos + 1 as int), cast(1 as int), cast(2 as int), '', 'x *e* y', cast(pos + 1 as int) from l"""
)
def fb2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb2.chunks(_fb2(spark, sf_dir)).drop("error")


@query(
    f"""with {LINES}, l as (select doc_id, pos, regexp_replace(line, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') as line from lines),
    p as (select doc_id, pos, case when {strip("substr(line, 1, 20)")} <> '' then '## ' || {strip("substr(line, 1, 20)")} || chr(10) || chr(10) else '' end
      || case when {strip("line")} <> '' then {strip("line")} || chr(10) || chr(10) else '' end || 'x e y' || chr(10) as t from l)
    select cast(doc_id as varchar) as doc_id, string_agg(t, chr(10) order by pos) as markdown from p group by doc_id"""
)
def plain_fb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auto.markdown(_fb2(spark, sf_dir)).select("doc_id", "markdown")


@query(
    """select cast(doc_id as varchar) as doc_id, case when doc_id % 2 = 0 then cast(doc_id as varchar) else 'n' || doc_id end as id, case when doc_id % 2 = 0 then lang else 'n' || doc_id end as title,
    case when doc_id % 2 = 0 then 'A B' else '' end as authors, case when doc_id % 2 = 0 then 'de' end as language from documents"""
)
def auto_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.concat(F.lit("books/n"), F.col("doc_id").cast("string"), F.lit(".djvu"))
    files = _fb2(spark, sf_dir).withColumn("path", F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(other))
    return auto.metadata(files).select("doc_id", "id", "title", F.array_join("authors", "|").alias("authors"), "language")


@query("select cast(doc_id as varchar) as doc_id, lang as title, 'A B' as authors, 'de' as language, cast(2021 as int) as year, lang as id from documents")
def fb2_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb2.books(_fb2(spark, sf_dir)).select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "language", "year", "id")


# ---------------------------------------------------------------- pages in full: drawings, blocks of several lines, pages without text

MIXED = f"""{LINES}, mixed as (
  select doc_id, cast(pos // 30 as int) as page_no, cast(pos // 3 as int) as block_no, cast(pos % 3 as int) as line_no, pos,
    case when pos // 3 % 13 = 12 then 1 else 0 end as kind, case when pos % 3 = 0 and pos // 3 % 4 = 0 then 'Part ' || (pos // 3) else line end as line,
    cast(case when pos // 3 % 8 = 0 then 24 when pos // 3 % 8 = 4 then case when doc_id % 2 = 0 then 18 else 15 end else 11 end as double) as size,
    cast(case when pos % 3 = 1 then 2 + 16 else 4 end as int) as flags
  from lines where doc_id % 10 <> 9)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three lines, a line in two spans, some blocks images; every tenth document has images and page marks alone."""
    pos, doc = F.col("pos"), F.col("doc_id")
    block = F.floor(pos / 3).cast("int")
    rows = V.doc_lines(spark, sf_dir).select("doc_id", "pos", F.when((pos % 3 == 0) & (block % 4 == 0), F.concat(F.lit("Part "), block.cast("string"))).otherwise(F.col("line")).alias("line"))
    half = F.floor(F.char_length("line") / 2).cast("int")
    cut = F.array(F.struct(F.lit(0).alias("span_no"), F.substring(F.col("line"), F.lit(1), half).alias("text")), F.struct(F.lit(1).alias("span_no"), F.substring(F.col("line"), half + 1, F.lit(2147483647)).alias("text")))
    size = F.when(block % 8 == 0, 24.0).when(block % 8 == 4, F.when(doc % 2 == 0, 18.0).otherwise(15.0)).otherwise(11.0)
    kind = F.when(doc % 10 == 9, F.when(pos % 2 == 0, 1).otherwise(-2)).when(block % 13 == 12, 1).otherwise(0)
    rows = rows.select("doc_id", F.floor(pos / 30).cast("int").alias("page_no"), block.alias("block_no"), (pos % 3).cast("int").alias("line_no"), kind.alias("block_type"),
                       size.alias("size"), F.lit("Serif").alias("font"), F.when(pos % 3 == 1, 18).otherwise(4).alias("flags"), F.explode(cut).alias("s"))
    return rows.select("doc_id", "page_no", "block_no", "line_no", "s.span_no", "block_type", F.when(F.col("block_type") == 0, F.col("s.text")).alias("text"), "size", "font", "flags")


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing a line: more than 50 within the first ten pages of long documents."""
    return V.doc_lines(spark, sf_dir).select("doc_id", F.floor(F.col("pos") / 8).cast("int").alias("page_no"))


@query(
    f"""with {MIXED}, pages as (select doc_id, cast(max(pos) // 30 + 1 as int) as page_count from lines group by doc_id),
    text as (select m.*, page_count from mixed m join pages p on m.doc_id = p.doc_id where kind = 0),
    chars as (select doc_id, sum(case when page_no < 5 then len(regexp_extract_all(line, '[^\\x00-\\x7F\\x{{4E00}}-\\x{{9FFF}}]')) else 0 end) as strange, sum(case when page_no < 5 then length(line) + 1 else 0 end) as chars,
      bool_or(page_no >= page_count - 20 and {m("line", P.INDEX_LINE)}) as has_index from text group by doc_id),
    counted as (select doc_id, page_no, count(*) * 2 as n from text group by all),
    before as (select doc_id, page_no, coalesce(sum(n) over (partition by doc_id order by page_no rows between unbounded preceding and 1 preceding), 0) as b from counted),
    sizes as (select t.doc_id, list_sort(flatten(list([size, size]))) as v from text t join before b on t.doc_id = b.doc_id and t.page_no = b.page_no and b <= 200 group by t.doc_id),
    drawn as (select doc_id, cast(count(*) as int) as n from lines where pos // 8 < 10 group by doc_id),
    a as (select p.doc_id, page_count, coalesce(chars, 0) = 0 or strange / greatest(chars, 1) < 0.3 as ok, coalesce(has_index, false) as has_index, coalesce(round(v[len(v) // 2 + 1], 1), 12.0) as size, coalesce(n, 0) as n
      from pages p left join chars c on p.doc_id = c.doc_id left join sizes s on p.doc_id = s.doc_id left join drawn d on p.doc_id = d.doc_id)
    select doc_id, case when not ok then 'cjk-broken' when n > 50 then 'diagram-heavy' else 'born-digital' end as type, cast(size as double) as body_size, ok as encoding_ok, page_count, has_index, cast(n as int) as drawing_clusters from a"""
)
def drawing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.profile(_mixed(spark, sf_dir), _drawings(spark, sf_dir))


MIXED_BLOCKS = f"""{MIXED}, mb as (select * from (select doc_id, page_no, block_no, {strip("string_agg(line, chr(10) order by line_no)")} as text, max(size) as size, bool_or((flags & 2) <> 0) as is_bold
  from mixed where kind = 0 group by doc_id, page_no, block_no) where text <> '')"""


@query(f"with {MIXED_BLOCKS} select * from mb")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.blocks(_mixed(spark, sf_dir))


@query(
    f"""with {MIXED_BLOCKS}, c1 as (select *, case when size >= 11.0 * 1.3 then case when size / 11.0 >= 2.0 then 1 when size / 11.0 >= 1.6 then 2 else 3 end end as level, string_split(text, chr(10))[1] as first from mb),
    c2 as (select *, count(level) over (partition by doc_id order by page_no, block_no {ROWS}) as head, case when level is not null then case when level < 3 then {strip("substr(text, length(first) + 2)")} else '' end
      when not {m("text", P.PAGE_NUMBER)} and not {m("text", P.RUNNING_HEADER)} then text end as piece from c1)
    select doc_id, cast(head - 1 as int) as sequence, {strip("max(case when level is not null then first end)")} as heading, coalesce(string_agg(nullif(piece, ''), chr(10) || chr(10) order by page_no, block_no), '') as content, cast(max(level) as int) as level,
      max(case when level is not null then size end) as font_size, bool_or(level is not null and is_bold) as is_bold from c2 where head > 0 group by doc_id, head"""
)
def heading_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's first line is the heading, the rest content at levels 1 and 2."""
    sizes = V.table(spark, sf_dir, "documents").select("doc_id", F.lit(11.0).alias("body_size"))
    return pdf.rich_chunks(_mixed(spark, sf_dir), sizes).select("doc_id", "sequence", "heading", "content", "level", "font_size", "is_bold")


# ---------------------------------------------------------------- archives, pages of HTML, cards, sinks


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An EPUB of every five pages; some have no table of contents, some are no archives."""

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, pages in zip(batch["book"], batch["pages"], strict=True):
                names = [(p["page_id"], f"p{p['page_id']}.xhtml", p["url"]) for p in pages]
                item = '<item id="i{0}" href="{1}" media-type="application/xhtml+xml"/>'
                point = '<navPoint><navLabel><text>{0}</text></navLabel><content src="{1}#top"/></navPoint>'
                toc = "".join(point.format(f"Told {n}" if n % 4 else "", f) for n, f, _ in names if n % 2 == 0) if book % 3 else ""
                parts = {
                    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="b/book.opf"/></rootfiles></container>',
                    "b/book.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
                    + "".join(item.format(n, f) for n, f, _ in names) + '</manifest><spine toc="ncx">' + "".join(f'<itemref idref="i{n}"/>' for n, _, _ in reversed(names)) + "</spine></package>",
                    "b/toc.ncx": f"<ncx><navMap>{toc}</navMap></ncx>",
                } | {f"b/{f}": f"<html><head><title>no</title></head><body><h1>Page {n}</h1><p>{escape(u)}</p><h2>Part {n}</h2><p>Text <b>bold</b> {n}</p><h4>Deep</h4><p>end</p></body></html>" for n, f, u in names}
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, text in parts.items():
                        z.writestr(name, text)
                rows.append((str(book), f"books/{book}.epub", b"torn" if book % 7 == 6 else out.getvalue()))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "content"])

    pages = F.array_sort(F.collect_list(F.struct("page_id", "url")))
    books = V.table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 5).alias("book")).agg(pages.alias("pages"))
    return books.mapInPandas(zipped, "doc_id string, path string, content binary")


@query(
    """with b as (select page_id, url, page_id // 5 as book from pages),
    told as (select book, bool_or(page_id % 2 = 0) as has from b where book % 3 <> 0 group by book),
    c as (select b.*, coalesce(has, false) as toc from b left join told on b.book = told.book where b.book % 7 <> 6),
    n as (select *, row_number() over (partition by book order by case when toc then page_id else -page_id end) as no from c where not toc or page_id % 2 = 0),
    s as (select book, no, 0 as place, case when toc and page_id % 4 <> 0 then 'Told ' || page_id else 'Page ' || page_id end as heading, 1 as level, url as content from n
      union all select book, no, 1, 'Part ' || page_id, 2, 'Text **bold** ' || page_id from n union all select book, no, 2, 'Deep', 3, 'end' from n)
    select cast(book as varchar) as doc_id, cast(no as int) as group_no, cast(place as int) as chunk_pos, heading, cast(level as int) as level, content, cast(no as int) as group_chapter_no, cast(null as varchar) as error from s
    union all select distinct cast(book as varchar), cast(null as int), cast(null as int), null, cast(null as int), null, cast(null as int), 'BadZipFile: File is not a zip file' from b where book % 7 = 6"""
)
def epub_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.read(_archives(spark, sf_dir))[1]


HTML_SQL = """'# Page ' || page_id || '\n\nSee [' || 'the site](' || url || ') and *more* `x`\n\n- one\n- two\n  1. in\n\n> said\n\n| K | V |\n| --- | --- |\n| ' || page_id || ' | **' || url || '** |\n\n|  |  |\n| --- | --- |\n| a | b |\n\n```\nkept  as is\n```\n\nend'"""


@query(f"select page_id, {HTML_SQL} as markdown from pages")
def html_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id").cast("string"), F.col("url")
    html = F.concat(
        F.lit("<html><head><title>t</title></head><body><h1>Page "), page, F.lit("</h1><script>x()</script><p>See <a href='"), url, F.lit("'>the site</a> and <i>more</i> <code>x</code></p><ul><li>one</li><li>two<ol><li>in</li></ol></li></ul>"
        "<blockquote><p>said</p></blockquote><img src='p.png'><table><tr><th>K</th><th>V</th></tr><tr><td>"), page, F.lit("</td><td><b>"), url, F.lit("</b></td></tr></table><table><tr><td>a</td><td>b</td></tr></table><pre>kept  as is</pre>end"),
    )
    return V.table(spark, sf_dir, "pages").select("page_id", markdown_of(html).alias("markdown"))


METAS = """m as (select doc_id, 'stem' || doc_id as stem, case doc_id % 4 when 0 then '' when 1 then 'stem' || doc_id else ' Title ' || doc_id || ' ' end as title,
  case when doc_id % 3 = 0 then 'Doe, J; Poe, E' when doc_id % 3 = 1 then '' end as author, case when doc_id % 5 = 0 then 'D:' || (1990 + doc_id % 30) || '0101' when doc_id % 5 = 1 then '' end as created,
  case when doc_id % 2 = 0 then 'D:2015' end as modified, case when doc_id % 7 = 0 then 'de' end as language from documents),
own as (select doc_id, regexp_replace(regexp_replace(lower(trim(coalesce(nullif(title, ''), stem))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as id, trim(coalesce(nullif(title, ''), stem)) as title,
  case when doc_id % 3 = 0 then 'J Doe|E Poe' else '' end as authors, coalesce(language, 'en') as language, case when doc_id % 5 = 0 then cast(1990 + doc_id % 30 as int) end as year from m),
art as (select doc_id, case when trim(title) <> '' and trim(title) <> stem then trim(title) when doc_id % 2 = 0 then 'Found ' || doc_id else stem end as title,
  case when doc_id % 3 = 0 then 'Doe|J; Poe|E' else '' end as authors,
  coalesce(try_cast(nullif(regexp_extract(coalesce(nullif(created, ''), nullif(modified, ''), ''), '(20[0-9]{2})', 1), '') as int), 0) as year from m)"""


def _metas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    doc = F.col("doc_id")
    s = doc.cast("string")
    rows = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("stem"), s).alias("stem"), F.when(doc % 4 == 0, "").when(doc % 4 == 1, F.concat(F.lit("stem"), s)).otherwise(F.concat(F.lit(" Title "), s, F.lit(" "))).alias("title"),
        F.when(doc % 3 == 0, "Doe, J; Poe, E").when(doc % 3 == 1, "").alias("author"), F.when(doc % 5 == 0, F.concat(F.lit("D:"), (1990 + doc % 30).cast("string"), F.lit("0101"))).when(doc % 5 == 1, "").alias("creationDate"),
        F.when(doc % 2 == 0, "D:2015").alias("modDate"), F.when(doc % 7 == 0, "de").alias("language"),
    )
    return rows, rows.where(doc % 2 == 0).select("doc_id", F.concat(F.lit("Found "), s).alias("title"))


def _card(books: DataFrame) -> DataFrame:
    return books.select("doc_id", "id", "title", F.array_join("authors", "|").alias("authors"), "language", "year", "source_format", "book_type")


@query(f"with {METAS} select *, 'pdf' as source_format, 'technical' as book_type from own")
def pdf_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _card(M.pdf_books(_metas(spark, sf_dir)[0]))


@query(f"with {METAS} select doc_id, '' as id, title, authors, 'en' as language, year, 'pdf' as source_format, '' as book_type from art")
def article_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _card(M.article_books(*_metas(spark, sf_dir)))


@query(
    f"""with {METAS} select art.doc_id, case when own.id <> '' then own.id else '' end as id, art.title, case when own.authors <> '' then own.authors else art.authors end as authors, own.language,
    case when coalesce(own.year, 0) <> 0 then own.year else art.year end as year, 'pdf' as source_format, 'technical' as book_type from art join own on art.doc_id = own.doc_id"""
)
def merged_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, titles = _metas(spark, sf_dir)
    return _card(M.merge_books(M.article_books(rows, titles), M.pdf_books(rows)))


@query("select * from (values ('tech-lib', 'dev'), ('tech-lib', 'ops'), ('tech-lib', 'src3')) as t(collection, domain)")
def vocabulary_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's domains from a file above the folder asked for."""
    with tempfile.TemporaryDirectory() as top:  # read by the driver at once
        below = Path(top, "a", "b")
        below.mkdir(parents=True)
        Path(top, vocabulary.FILE).write_text("collections:\n  other: {domains: [x]}\n  tech-lib:\n    domains: [dev, ops, src3]\n    topics_registry: [k8s]\n")
        return vocabulary.table(spark, below, "tech-lib")


@query(
    f"""with {BOOK.replace("as id, coalesce(nullif(title", "|| '-' || doc_id as id, coalesce(nullif(title").replace("string_split(text, chr(10))[1] as title", "'Book' as title")}
    select id || '/01-book.md' as path, '---' || {NEW} || 'book_id: ' || id || {NEW} || 'chapter_no: 1' || {NEW} || 'chapter_title: Book' || {NEW} || 'sequence: 1' || {NEW} || '---' || {NEW} || {NEW} || 'c' || doc_id || {NEW} as body from card
    union all select id || '/00-book.md', '---' || {NEW} || array_to_string(['id: ' || id, 'title: Book', {_list_sql("authors")}, {_list_sql("domains")}, {_list_sql("topics")},
      'book_type: technical', 'source_format: null', 'language: ' || language, 'year: ' || coalesce(cast(year as varchar), 'null'), 'edition: null', 'status: unread', 'priority: high'], {NEW}) || {NEW} || '---' || {NEW} from card"""
)
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card and a chapter of every document, written to a tree in the shared folder and read again."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quire-tree-")).rstrip("/")
    folder = f"{root}/tree-{uuid.uuid4().hex}"
    books = _books(spark, sf_dir).select("*").withColumn("title", F.lit("Book")).withColumn("id", F.concat(F.lit("book-"), F.col("doc_id").cast("string")))
    chunks = books.select("doc_id", F.lit(1).alias("group_no"), F.lit(0).alias("chunk_pos"), F.lit("Book").alias("heading"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content"), F.lit(1).alias("level"), F.lit(1).alias("group_chapter_no"))
    write_tree(rendered(books, chunks), folder)
    return read_tree(unique_ids(books), folder)


@query(
    f"""select doc_id, 'id: ' || doc_id || {NEW} || 'tags:' || {NEW} || '  - ' || {quote_sql("source")} || {NEW} || '  - ' || {quote_sql("lang || ': x'")} || {NEW} || 'nested:' || {NEW} || '  deep:' || {NEW} || '    - a: ' || doc_id || {NEW} || '      b: null' || {NEW} || '  empty: []' || {NEW} || '  none: {{}}'
      || {NEW} || 'flag: ' || case when doc_id % 2 = 0 then 'true' else 'false' end as yaml from documents"""
)
def yaml_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def rendered_yaml(doc: pd.Series, source: pd.Series, lang: pd.Series) -> pd.Series:
        values = ({"id": int(d), "tags": [s, f"{x}: x"], "nested": {"deep": [{"a": int(d), "b": None}], "empty": [], "none": {}}, "flag": int(d) % 2 == 0} for d, s, x in zip(doc, source, lang, strict=True))
        return pd.Series([render.to_yaml(v) for v in values])

    return V.table(spark, sf_dir, "documents").select("doc_id", rendered_yaml("doc_id", "source", "lang").alias("yaml"))
