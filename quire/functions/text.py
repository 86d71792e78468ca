"""Column functions on text: stripping, lines, slugs, titles, YAML scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

#: What makes a YAML scalar need quotes.
YAML_FIRST = "{['\"&*!|>%@`"
YAML_WORDS = ("true", "false", "null", "yes", "no", "on", "off")
YAML_ANYWHERE = ":#{}[],&*?|<>=!%@`'"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, P.java(P.EDGES), "")


def blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def matches(c: Column, pattern: str, fold: bool = False) -> Column:
    return c.rlike(P.java(pattern, fold))


def part_of(c: Column, pattern: str, group: int, fold: bool = False) -> Column:
    """A group of the first match, null where there is none."""
    return blank(F.regexp_extract(c, P.java(pattern, fold), group))


def number_of(c: Column, pattern: str, group: int, fold: bool = False) -> Column:
    return part_of(c, pattern, group, fold).try_cast("int")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, line of every line of a text."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def slug(c: Column) -> Column:
    """Lower-case letters (Latin and Cyrillic) and digits; runs of others become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9а-я]+", "-"), "^-+|-+$", "")


def ascii_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_slug(c: Column, longest: int = 60) -> Column:
    return F.coalesce(blank(F.substring(slug(c), 1, longest)), F.lit("untitled"))


def first_line(content: Column) -> Column:
    """The first line that isn't blank, stripped; null where there is none."""
    kept = F.filter(F.transform(F.split(content, "\n", -1), strip), lambda x: x != "")
    return F.try_element_at(kept, F.lit(1))


def chapter_title(heading: Column, content: Column) -> Column:
    """The heading; of a bare "Chapter 3" the first line of its content, unless that is longer than 80 characters."""
    h, line = strip(heading), first_line(content)
    return F.when(matches(h, P.BARE_CHAPTER, True) & line.isNotNull() & (F.char_length(line) <= 80), line).otherwise(h)


def topics(c: Column) -> Column:
    """Kebab-case, empty ones dropped, order and repeats kept."""
    return F.filter(F.transform(c, slug), lambda t: t != "")


def yaml_text(c: Column) -> Column:
    def any_of(marks: str) -> str:
        return "[" + "".join("\\" + m for m in marks) + "]"

    unsafe = (
        c.rlike("^" + any_of(YAML_FIRST))
        | F.lower(c).isin(*YAML_WORDS)
        | c.rlike(any_of(YAML_ANYWHERE))
        | (strip(c) != c)
        | c.startswith("- ")
    )
    return F.when(c == "", F.lit("''")).when(unsafe, F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c)
