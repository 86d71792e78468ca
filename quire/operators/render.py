"""Books and chapters to markdown files with YAML frontmatter, as columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chapter_title, file_slug, yaml_text
from .meta import BOOK_FIELDS


def fenced(body: Column) -> Column:
    return F.concat(F.lit("---\n"), body, F.lit("\n---\n"))


def _entry(name: str, c: Column, kind: str) -> Column:
    if kind.startswith("array"):
        items = F.array_join(F.transform(c, lambda x: F.concat(F.lit("\n  - "), yaml_text(x))), "")
        return F.when(F.size(c) == 0, F.lit(f"{name}: []")).otherwise(F.concat(F.lit(f"{name}:"), items))
    text = yaml_text(c) if kind == "string" else c.cast("string")
    return F.concat(F.lit(f"{name}: "), F.coalesce(text, F.lit("null")))


def book_card(books: DataFrame) -> DataFrame:
    """doc_id, card: the frontmatter of a normalised book."""
    kinds = dict(books.dtypes)
    return books.select("doc_id", fenced(F.concat_ws("\n", *[_entry(c, F.col(c), kinds[c]) for c in BOOK_FIELDS])).alias("card"))


def chapter_files(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """chunks(doc_id, group_no, chunk_pos, heading, content, level, group_chapter_no[, part]) and books(doc_id, id) ->
    doc_id, group_no, path, body of one file a chapter."""
    part = F.col("part") if "part" in chunks.columns else F.lit("")
    first = F.col("chunk_pos") == 0
    title = chapter_title(F.col("heading"), F.col("content"))
    marks = F.repeat(F.lit("#"), F.least(F.greatest(F.col("level"), F.lit(2)), F.lit(6)))
    heading = F.when(F.col("heading") != "", F.concat(marks, F.lit(" "), F.col("heading")))
    section = F.when(first, F.nullif("content", F.lit(""))).otherwise(F.nullif(F.concat_ws("\n\n", heading, F.nullif("content", F.lit(""))), F.lit("")))
    rows = chunks.select("doc_id", "group_no", "chunk_pos", "group_chapter_no", section.alias("section"), F.when(first, title).alias("title"), F.when(first, part).alias("part"))
    body = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("chunk_pos", "section"))), lambda x: x["section"]), lambda s: s.isNotNull()), "\n\n")
    files = rows.groupBy("doc_id", "group_no").agg(F.max("title").alias("title"), F.max("part").alias("part"), F.max("group_chapter_no").alias("number"), body.alias("text"))
    files = files.join(books.select("doc_id", "id"), "doc_id")
    front = F.concat_ws(
        "\n", F.concat(F.lit("book_id: "), yaml_text(F.col("id"))), F.concat(F.lit("chapter_no: "), F.col("number").cast("string")), F.concat(F.lit("chapter_title: "), yaml_text(F.col("title"))),
        F.concat(F.lit("sequence: "), F.col("group_no").cast("string")), F.when(F.col("part") != "", F.concat(F.lit("part: "), yaml_text(F.col("part")))),
    )
    whole = F.concat(F.concat_ws("\n\n", F.concat(F.lit("---\n"), front, F.lit("\n---")), F.nullif("text", F.lit(""))), F.lit("\n"))
    path = F.concat(F.col("id"), F.lit("/"), F.format_string("%02d-%s.md", F.col("group_no").cast("int"), file_slug(F.col("title"))))
    return files.select("doc_id", F.col("group_no").cast("int").alias("group_no"), path.alias("path"), whole.alias("body"))


def dry_run(chunks: DataFrame) -> DataFrame:
    """doc_id, group_no, chunk_pos, label, preview: the heading with its place, and 80 characters of content on one line."""
    label = F.format_string("[%02d] %s", F.coalesce(F.col("sequence") if "sequence" in chunks.columns else F.col("chunk_pos"), F.lit(0)).cast("int") + 1, F.col("heading"))
    return chunks.select("doc_id", "group_no", "chunk_pos", label.alias("label"), F.translate(F.substring("content", 1, 80), "\n", " ").alias("preview"))


# ---------------------------------------------------------------- any nesting, on the driver or in a UDF


def quote(s: str) -> str:
    """A YAML scalar; the same rule as the column function yaml_text."""
    from ..functions.text import YAML_ANYWHERE, YAML_FIRST, YAML_WORDS

    if not s:
        return "''"
    unsafe = s[0] in YAML_FIRST or s.lower() in YAML_WORDS or any(c in YAML_ANYWHERE for c in s) or s != s.strip() or s.startswith("- ")
    return "'" + s.replace("'", "''") + "'" if unsafe else s


def to_yaml(value: Any, depth: int = 0) -> str:
    """Block-style YAML of scalars, lists and dictionaries, two spaces a level."""
    if isinstance(value, dict) and value:
        return "\n".join("  " * depth + line for line in _pairs(value, depth, "  " * depth))
    if isinstance(value, (list, tuple)) and value:
        pad, out = "  " * depth, []
        for item in value:
            if isinstance(item, dict):
                lines = _pairs(item, depth + 1, pad + "  ")
                out += [f"{pad}- {line}" if i == 0 else f"{pad}  {line}" for i, line in enumerate(lines)]
            else:
                out.append(f"{pad}- {to_yaml(item, depth + 1)}")
        return "\n".join(out)
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, dict):
        return "{}"
    if isinstance(value, (list, tuple)):
        return "[]"
    return quote(str(value))


def _pairs(mapping: dict, depth: int, pad: str) -> list[str]:
    """Entries of a mapping; only the first line of each lacks its padding."""
    out = []
    for key, value in mapping.items():
        nested = isinstance(value, (dict, list, tuple)) and len(value) > 0
        out.append(f"{quote(str(key))}:\n{to_yaml(value, depth + 1)}" if nested else f"{quote(str(key))}: {to_yaml(value)}")
    return out


def frontmatter(meta: dict) -> str:
    return "---\n" + (to_yaml(meta) + "\n" if meta else "") + "---\n"
