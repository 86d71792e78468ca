import pytest
import yaml
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.score import looks_like_index, looks_like_toc, score_heading
from quire.operators import meta as M
from quire.operators import render


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_slugs(spark):
    assert column(spark, ["Hello, World!", "--", "Ёлка и Дом", "A" * 80, "  x  "], T.slug) == ["hello-world", "", "лка-и-дом", "a" * 80, "x"]
    assert column(spark, ["", "Ab " * 40], T.file_slug) == ["untitled", ("ab-" * 40)[:60]]
    assert column(spark, ["Книга Test"], T.ascii_slug) == ["test"]


def test_strip_takes_all_white_space(spark):
    values = ["  a b \n", "\x1c\x85x\r", "", "\t"]
    assert column(spark, values, T.strip) == [v.strip() for v in values]


def test_chapter_titles(spark):
    rows = [("CHAPTER 1", "\n  Low Water in the Cloud \nx"), ("Глава 2.", "Имя"), ("Chapter 3: Named", "no"), ("chapter 4", "y" * 81), ("Section 5", " \n")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, c string").orderBy("i")
    got = [r[0] for r in df.select(T.chapter_title(F.col("h"), F.col("c"))).collect()]
    assert got == ["Low Water in the Cloud", "Имя", "Chapter 3: Named", "chapter 4", "Section 5"]


YAML = ["", "plain", "true", "No", "a: b", "x#y", "it's", " lead", "trail ", "- item", "@at", "3", "1.5", "two words", "[x", "a,b", "what?", "ключ", "-dash"]


def test_yaml_scalars(spark):
    assert column(spark, YAML, T.yaml_text) == [render.quote(v) for v in YAML]
    for v in YAML:
        if v not in ("3", "1.5"):
            assert yaml.safe_load(render.quote(v)) == v


@pytest.mark.parametrize("value", [{}, {"a": None, "b": True, "c": [], "d": {}, "e": ["x", "y: z"], "f": {"g": [1, 2.5], "h": {"i": "it's"}}, "j": [{"k": "v", "l": [1], "m": {"n": 2}}, {"o": []}]}])
def test_frontmatter_round_trips(value):
    text = render.frontmatter(value)
    assert text.startswith("---\n") and text.endswith("---\n")
    assert (yaml.safe_load(text.split("---")[1]) or {}) == value


def test_score(spark):
    rows = [
        ("Chapter 1: Introduction", 2, 18.0, False), ("CHAPTER", 1, 24.0, True), ("chapters", 2, 11.0, False), ("1.2 Setup", 3, 15.0, False), ("Intro ..... 12", 3, 15.0, False), ("A", 2, 18.0, False),
        ("A", 1, 24.0, False), ("X, Y", 3, 15.0, False), ("***", 3, 15.0, False), ("   ", 1, 24.0, True), ("Часть первая", 1, 24.0, False), ("12", 2, 18.0, False), ("Глава_x", 3, 13.0, False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, level int, size double, bold boolean").orderBy("i")
    no = F.lit(False)
    got = [r[0] for r in df.select(score_heading(F.col("h"), F.col("level"), F.col("size"), F.col("bold"), no, looks_like_toc(F.col("h")), looks_like_index(F.col("h")), F.lit(11.0))).collect()]
    assert got == [9.0, 12.0, 0.0, 6.0, -17.0, -18.0, -8.0, -15.0, -14.0, 0.0, 5.0, -2.0, 1.0]


def test_authors_and_years(spark):
    assert column(spark, ["Holt, Mira; Roe, R. ;", "Solo", "A, B, C", "", ";;"], M.split_pdf_authors) == [["Mira Holt", "R. Roe"], ["Solo"], ["A, B, C"], [], []]
    assert column(spark, ["Ann Lee and Bo", "Cy "], M.split_epub_author) == [["Ann Lee", "Bo"], ["Cy"]]
    assert column(spark, ["D:20220315184501Z", "2022", None], M.pdf_year) == [2022, None, None]
    assert column(spark, [["DevOps & SRE", "--", "k8s", "k8s"]], T.topics, "array<string>") == [["devops-sre", "k8s", "k8s"]]


def test_cards_have_defaults(spark):
    raw = spark.createDataFrame([(1, "", None, 0), (2, "Ты и я", "id-2", 2020)], "doc_id int, title string, id string, year int")
    a, b = M.normalize(raw).orderBy("doc_id").collect()
    assert list(a.asDict())[1:] == list(M.BOOK_FIELDS)
    assert (a.id, a.title, a.authors, a.book_type, a.language, a.year, a.status, a.priority, a.edition) == ("untitled", "untitled", [], "technical", "en", 0, "unread", "high", None)
    assert (b.id, b.year) == ("id-2", 2020)
    card = render.book_card(M.normalize(raw)).orderBy("doc_id").first().card
    assert yaml.safe_load(card.split("---")[1])["authors"] == [] and card.index("id:") < card.index("title:") < card.index("priority:")


def test_domains(spark):
    vocabulary = spark.createDataFrame([("tech", "dev"), ("tech", "ops"), ("other", "x")], "collection string, domain string")
    given = spark.createDataFrame([(1, ["dev", "x", "x"]), (2, []), (3, ["ops"]), (4, None)], "doc_id int, domains array<string>")
    got = sorted(((r.doc_id, r.domain) for r in M.unknown_domains(given, vocabulary, "tech").collect()), key=str)
    assert got == [(1, "x"), (1, "x"), (2, None), (4, None)]
    with pytest.raises(M.SchemaError, match="missing .*has: dev, ops"):
        M.require_domains([], ["ops", "dev"], "tech")
    with pytest.raises(M.SchemaError, match="outside the vocabulary: x "):
        M.require_domains(["dev", "x", "x"], ["ops", "dev"], "tech")
    M.require_domains(["dev"], ["ops", "dev"], "tech")


def test_tenths_are_rounded_like_binary_values(spark):
    import random

    from quire.functions.rounding import tenth

    rng = random.Random(5)
    values = [0.05, 0.15, 0.25, 0.35, 0.45, 1.25, 2.5, 10.95, 11.05, 12.0, -0.35, 0.0] + [rng.uniform(-50, 50) for _ in range(2000)] + [round(rng.uniform(0, 50), 2) for _ in range(2000)] + [k / 20 for k in range(600)]
    got = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", tenth("v").alias("t")).collect()
    assert all(r.t == round(r.v, 1) for r in got if r.v is not None) and [r.t for r in got if r.v is None] == [None]
