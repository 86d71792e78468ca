"""The heading score: additive, built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import matches, strip


def looks_like_toc(line: Column) -> Column:
    return matches(line, P.TOC_END) | matches(line, P.TOC_START)


def looks_like_index(line: Column) -> Column:
    return matches(line, P.INDEX_LETTER)


def score_heading(heading: Column, level: Column, size: Column, bold: Column, near_drawing: Column, toc: Column, index: Column, body: Column, stripped: bool = False) -> Column:
    """Fixed weights; a heading that strips to nothing scores 0. stripped: the heading is so already, and isn't stripped for each rule."""
    text = heading if stripped else strip(heading)

    def points(n: int, when: Column) -> Column:
        return F.when(when, F.lit(float(n))).otherwise(F.lit(0.0))

    total = (
        points(-5, F.char_length(text) < 4)
        + points(-8, matches(text, P.TOC_END))
        + points(-8, matches(text, P.TOC_START))
        + points(-8, matches(text, P.INDEX_LETTER) & (level >= 2))
        + points(-10, matches(text, P.NONWORD))
        + points(6, matches(text, P.KEYWORD, True))
        + points(5, matches(text, P.NUMBERED))
        + F.when(size >= body * 2.0, 5.0).when(size >= body * 1.6, 3.0).when(size >= body * 1.18, 1.0).otherwise(0.0)
        + points(1, bold)
        + points(-6, near_drawing)
        + points(-10, toc)
        + points(-8, index)
    )
    return F.when(text == "", F.lit(0.0)).otherwise(total)
