"""Deterministic views of the driver's tables that hold what the operators look for, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _cut(n: int):
    return F.substring("line", 1, n)


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _whole(c, n: int):
    return F.floor(F.col(c) / n).cast("int")


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") + F.col("pos")) % 20
    ten = (_whole("pos", 10) + 1).cast("string")
    line = (
        F.when(k == 0, _text("# Part ", (_whole("pos", 20) + 1).cast("string")))
        .when(k == 5, "# Title page")
        .when(k.isin(2, 9), _text("## Chapter ", ten, ": ", _cut(20)))
        .when(k == 12, _text("## ", _cut(20)))
        .when(k == 7, _text("### ", ten, ".", F.col("pos").cast("string"), " ", _cut(15)))
        .when(k == 15, _text("### ", _cut(15)))
        .when((k == 17) & (F.col("pos") % 3 == 0), "## Index")
        .otherwise(F.col("line"))
    )
    return doc_lines(spark, sf_dir).select("doc_id", "pos", line.alias("line"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span a line."""
    k, pos = (F.col("doc_id") + F.col("pos")) % 11, F.col("pos")
    n = (_whole("pos", 11) + 1).cast("string")
    toc = (k == 10) & (pos % 3 == 0)
    text = (
        F.when(k == 0, _cut(12)).when(k == 2, _text("Chapter ", n, " ", _cut(20))).when(k == 8, _text(n, ".2 ", _cut(20))).when(k == 5, _cut(18))
        .when((k == 9) & (pos % 2 == 0), pos.cast("string")).when(toc, _text("Intro ..... ", pos.cast("string"))).otherwise(F.col("line"))
    )
    size = F.when(k == 0, 24.0).when(k.isin(2, 8), 18.0).when(k == 5, 15.0).when(toc & (pos % 2 == 1), 15.0).otherwise(11.0)
    font = F.when((F.col("doc_id") + pos) % 2 == 0, "Serif-Bold").otherwise("Serif")
    return doc_lines(spark, sf_dir).select(
        "doc_id", _whole("pos", 4).alias("page_no"), pos.alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), F.lit(0).alias("block_type"),
        text.alias("text"), size.alias("size"), font.alias("font"), F.lit(0).alias("flags"),
    )


def article_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the headings, page numbers and journal headers of articles among them."""
    k, pos = (F.col("doc_id") * 3 + F.col("pos")) % 13, F.col("pos")
    n = (_whole("pos", 5) + 1).cast("string")
    line = (
        F.when(k == 0, "INTRODUCTION").when(k == 2, pos.cast("string")).when(k == 4, _text(n, ". Model design ", F.when(pos % 2 == 0, "and use").otherwise("in depth")))
        .when(k == 5, _text("European Journal of ", _cut(10))).when(k == 7, F.when(pos % 2 == 0, "RELATED WORK:").otherwise("Chapter 3"))
        .when(k == 8, _text("- ", pos.cast("string"), " -")).when(k == 10, _text(n, ". The running text")).when(k == 11, _text("  ", F.col("line"), " "))
        .when(k == 12, "RESULTS").otherwise(F.col("line"))
    )
    return doc_lines(spark, sf_dir).select("doc_id", "pos", line.alias("line"))


# ---------------------------------------------------------------- the same in SQL


def m(column: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({column}, '{P.re2(pattern, fold)}')"


def x(column: str, pattern: str, group: int, fold: bool = False) -> str:
    return f"nullif(regexp_extract({column}, '{P.re2(pattern, fold)}', {group}), '')"


def n(column: str, pattern: str, group: int, fold: bool = False) -> str:
    return f"try_cast({x(column, pattern, group, fold)} as int)"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '{P.re2(P.EDGES)}', '', 'g')"


def slug(column: str) -> str:
    return f"regexp_replace(regexp_replace(lower({column}), '[^a-z0-9а-я]+', '-', 'g'), '^-+|-+$', '', 'g')"


LINES = """lines as (
  select doc_id, cast(i - 1 as int) as pos, line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"""
MARKDOWN = f"""{LINES}, md as (
  select doc_id, pos, case
    when k = 0 then '# Part ' || (pos // 20 + 1)
    when k = 5 then '# Title page'
    when k in (2, 9) then '## Chapter ' || (pos // 10 + 1) || ': ' || substr(line, 1, 20)
    when k = 12 then '## ' || substr(line, 1, 20)
    when k = 7 then '### ' || (pos // 10 + 1) || '.' || pos || ' ' || substr(line, 1, 15)
    when k = 15 then '### ' || substr(line, 1, 15)
    when k = 17 and pos % 3 = 0 then '## Index'
    else line end as line
  from (select *, (doc_id + pos) % 20 as k from lines))"""
SPANS = f"""{LINES}, spans as (
  select doc_id, cast(pos // 4 as int) as page_no, pos as block_no,
    case when k = 0 then substr(line, 1, 12)
      when k = 2 then 'Chapter ' || (pos // 11 + 1) || ' ' || substr(line, 1, 20)
      when k = 8 then (pos // 11 + 1) || '.2 ' || substr(line, 1, 20)
      when k = 5 then substr(line, 1, 18)
      when k = 9 and pos % 2 = 0 then cast(pos as varchar)
      when k = 10 and pos % 3 = 0 then 'Intro ..... ' || pos
      else line end as text,
    cast(case when k = 0 then 24 when k in (2, 8) then 18 when k = 5 then 15 when k = 10 and pos % 3 = 0 and pos % 2 = 1 then 15 else 11 end as double) as size,
    case when (doc_id + pos) % 2 = 0 then 'Serif-Bold' else 'Serif' end as font
  from (select *, (doc_id + pos) % 11 as k from lines))"""
ARTICLE = f"""{LINES}, raw as (
  select doc_id, pos, case
    when k = 0 then 'INTRODUCTION'
    when k = 2 then cast(pos as varchar)
    when k = 4 then (pos // 5 + 1) || '. Model design ' || case when pos % 2 = 0 then 'and use' else 'in depth' end
    when k = 5 then 'European Journal of ' || substr(line, 1, 10)
    when k = 7 then case when pos % 2 = 0 then 'RELATED WORK:' else 'Chapter 3' end
    when k = 8 then '- ' || pos || ' -'
    when k = 10 then (pos // 5 + 1) || '. The running text'
    when k = 11 then '  ' || line || ' '
    when k = 12 then 'RESULTS'
    else line end as line
  from (select *, (doc_id * 3 + pos) % 13 as k from lines))"""
