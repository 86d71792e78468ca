import random
import re

from pyspark.sql import functions as F

from quire.functions.text import lines
from quire.operators import split

WS = r"[\s\x0b\x1c-\x1f\x85]"
PART = re.compile(r"^(?:Part|Часть|Том|Book|Книга)\s+\w+", re.I)


def slow_split(text):
    """The rules, line by line."""
    out, open_, body, part = [], None, [], ""

    def close():
        content = "\n".join(body).strip()
        if open_ is not None and content:
            out.append([len(out), open_[1], content, open_[0], part])
        body.clear()

    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+)$", line)
        if not m:
            body.append(line)
        elif len(m[1]) > 1:
            close()
            open_ = (len(m[1]), m[2])
        elif PART.match(m[2]):
            close()
            open_, part = None, m[2]
    close()
    return out


def slow_numbers(chunks):
    part = title = ""
    now = counter = sections = 0
    out = []
    for _, heading, _, level, own in chunks:
        part = own or part
        if level <= 2:
            m = re.match(r"^(?:(\d+)[.)\s]|(?:Chapter|Глава|Section|Chapitre|Kapitel|Lecture|Параграф)\s+(\d+))", heading, re.I)
            counter = now = int(m[1] or m[2]) if m else counter + 1
            title, sections = heading, 0
        number = 0
        if level == 3:
            word = r"(?:Section|Параграф|Paragraf|Paragraph)\s+"
            if m := re.match(rf"^(?:{word})?(\d+)\.(\d+)", heading, re.I):
                now, number = int(m[1]), int(m[2])
            elif (m := re.match(rf"^{word}(\d+)", heading, re.I)) or (m := re.match(r"^(\d+)[.)]\s+", heading)):
                number = int(m[1])
            else:
                sections += 1
                number = sections
        out.append((part, now, title, number, f"{now:02d}{number:02d}"))
    return out


def random_markdown(seed):
    rng = random.Random(seed)
    heads = ["# Part One", "# Часть вторая", "# Title", "## Chapter 3: X", "## Intro", "## 7. Seven", "## Глава 5", "### 4.1 A", "### Section 2", "### plain", "### 3) third", "#### deep", "### Параграф 2.9", "####### no", "#bare", "## Chapter 9"]
    return "\n".join(rng.choice(heads) if rng.random() < 0.4 else rng.choice(["text", "", "  ", "more text\r", "ё line", " "]) for _ in range(rng.randint(0, 40)))


def test_split_and_numbers_equal_a_state_machine(spark):
    docs = [(i, random_markdown(i)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {}
    for r in split.enrich(split.split_markdown(lines(df))).orderBy("doc_id", "sequence").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in docs:
        want = slow_split(text)
        rows = got.get(i, [])
        assert [[r.sequence, r.heading, r.content, r.level] for r in rows] == [w[:4] for w in want], i
        assert [(r.part, r.chapter_no, r.chapter_title, r.section_no, r.sequence_str) for r in rows] == slow_numbers(want), i


def chunks(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, sequence int, heading string, level int, score double, chapter_no int")


def test_content_window(spark):
    def kept(*heads):
        return [r.heading for r in split.content_window(chunks(spark, [(h, 2, 0.0, 0) for h in heads])).orderBy("sequence").collect()]

    assert kept("Preface", "Chapter 1", "Text", "index", "Chapter 2") == ["Chapter 1", "Text"]
    assert kept("Preface", "Index", "End") == ["Preface", "Index", "End"]
    assert kept("Index", "1. Start", "Where to Go Next") == ["1. Start"]
    assert kept("Chapter 1", "Index of terms") == ["Chapter 1", "Index of terms"]


def test_groups_drop_what_comes_before_and_number_on(spark):
    rows = [("lead", 2, 1.0, 0), ("A", 1, 7.0, 0), ("a1", 3, 1.0, 0), ("B", 3, 9.0, 5), ("C", 2, 8.0, 0), ("D", 4, 9.0, 0)]
    got = split.chapter_groups(chunks(spark, rows), 7.0).orderBy("sequence").collect()
    assert [(r.heading, r.group_no, r.chunk_pos, r.group_chapter_no, r.group_title) for r in got] == [("A", 1, 0, 1, "A"), ("a1", 1, 1, 1, "A"), ("B", 2, 0, 5, "B"), ("C", 3, 0, 6, "C"), ("D", 3, 1, 6, "C")]
    assert split.above_score(chunks(spark, rows), 1.0).where(F.col("score") <= 1.0).count() == 0


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, "## A\nx")], "doc_id long, text string")
    plan = split.enrich(split.split_markdown(lines(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning(doc_id") <= 2
