"""The patterns of the structuring rules, once in the JVM's form and once in RE2's.

A pattern is written with {s} for white space, {d} for a digit and {end} for the end of a word; both forms read these as
Python's `re` does on text. `java` and `re2` give the forms; fold: case is ignored.
"""

from __future__ import annotations

#: The wordings that the rules look for.
PART = "^(?:Part|Часть|Том|Book|Книга){s}+{w}+"
H2_NUM = "^(?:({d}+)[.){S}]|(?:Chapter|Глава|Section|Chapitre|Kapitel|Lecture|Параграф){s}+({d}+))"
H3_DOTTED = "^(?:(?:Section|Параграф|Paragraf|Paragraph){s}+)?({d}+)\\.({d}+)"
H3_WORD = "^(?:Section|Параграф|Paragraf|Paragraph){s}+({d}+)"
H3_PLAIN = "^({d}+)[.)]{s}+"
MD_HEADING = "^(#{{1,6}}){s}+(.+)$"
TOC_END = "\\.{{3,}}{s}*{d}*{s}*$"
TOC_START = "^\\.{{3,}}"
INDEX_LETTER = "^(?:[A-ZА-Я]|[A-Z],{s}*[A-Z])$"
NONWORD = "^[^\\p{{L}}\\p{{N}}]+$"
KEYWORD = "^(?:chapter|part|appendix|lecture|lesson|module){end}"
NUMBERED = "^{d}+(?:\\.{d}+)*{s}+[^{S}]"
CONTENT_START = "^(?:CHAPTER|Part|Appendix){s}"
CONTENT_START_NUMBER = "^{d}+[.){S}]"
CONTENT_END = "^(?:Index|Where to Go Next)$"
PAGE_NUMBER = "^{d}+{s}*$"
RUNNING_HEADER = "^(?:.{{0,80}}\\|{s}*{d}+{s}*|{d}+{s}*\\|.{{0,80}})$"
JUNK = "European{s}+Journal{s}+of|Print{s}+ISSN|Online{s}+ISSN|Website:{s}*https?://|Publication{s}+of{s}+the|^{d}+$|^-{s}*{d}+{s}*-$"
CHAPTER_WORD = "^CHAPTER{s}*{d}+$"
APPENDIX_WORD = "^APPENDIX{s}*[A-Z]$"
ARTICLE_NUMBERED = "^({d}+)[.){S}]{{1,2}}{s}*([A-Z][A-Za-z{S}/-]{{3,45}})$"
PERSON = "^[A-Z][a-z]+(?:{s}+[A-Z][a-z]+){{2,}}$"
BARE_CHAPTER = "^(?:Chapter|Глава|Section){s}+{d}+\\.?{s}*$"
INDEX_LINE = "^Index{s}*$"
EDGES = "^{s}+|{s}+$"

#: Headings of articles that stand alone in capitals.
ACADEMIC = (
    "ABSTRACT", "INTRODUCTION", "BACKGROUND", "RELATED WORK", "LITERATURE REVIEW", "STATE OF THE ART", "METHODOLOGY", "METHOD",
    "APPROACH", "IMPLEMENTATION", "EXPERIMENTS", "EXPERIMENT", "EVALUATION", "RESULTS", "DISCUSSION", "CONCLUSION", "FUTURE WORK",
    "SUMMARY", "REFERENCES", "BIBLIOGRAPHY", "ACKNOWLEDGMENTS", "ACKNOWLEDGMENT", "APPENDIX", "APPENDIX A", "APPENDIX B",
    "APPENDIX C", "TABLE OF CONTENTS", "INDEX", "PROPOSED APPROACH", "PROPOSED WORK", "PROPOSED SYSTEM", "SYSTEM DESIGN",
    "SYSTEM ARCHITECTURE",
)
#: First words that mark a numbered line as running text.
BODY_STARTS = (
    "for", "the", "there", "this", "that", "these", "those", "with", "from", "which", "where", "when", "while", "using", "based",
    "according", "however", "therefore", "furthermore", "moreover", "although", "because", "since", "after", "before", "between",
    "through", "during", "within", "without", "across", "among", "about", "above", "below", "under", "over", "into", "onto",
    "also", "than", "then", "else", "even", "such", "each", "both", "shows", "showing", "following", "including", "provides",
)
#: What ends the title among an article's first lines.
TITLE_STOPS = ("doi:", "citation:", "keywords:", "abstract:", "university", "college", "institute", "school of", "department of", "faculty of", "©")
ACADEMIC_LINE = "^(?:" + "|".join(ACADEMIC) + "):?{s}*$"


def _fill(pattern: str, space: str) -> str:
    return pattern.format(s=f"[{space}]", S=space, d="[0-9]", w="[\\p{L}\\p{N}_]", end="(?:[^\\p{L}\\p{N}_]|$)")


def java(pattern: str, fold: bool = False) -> str:
    return ("(?iud)" if fold else "(?d)") + _fill(pattern, "\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85")


def re2(pattern: str, fold: bool = False) -> str:
    """For an SQL literal: quotes are doubled."""
    return (("(?i)" if fold else "") + _fill(pattern, "\\s\\pZ\\x0b\\x1c-\\x1f\\x{85}")).replace("'", "''")
