import random

from quire.functions.text import lines
from quire.operators import article, pdf
from quire.sources import spans as S

from . import books


def frame(spark, *docs):
    return spark.createDataFrame([r for name, pages in docs for r in books.spans(name, pages)], books.SPAN)


def test_rich_chunks_and_chapters(spark):
    s = frame(spark, ("rich", books.RICH))
    profile = pdf.profile(s)
    p = profile.first()
    assert (p.type, p.body_size, p.encoding_ok, p.page_count, p.has_index) == ("born-digital", 15.0, True, 4, False)
    rows = pdf.rich_chunks(s, spark.createDataFrame([("rich", 11.0)], "doc_id string, body_size double")).orderBy("sequence").collect()
    assert [(r.heading, r.level, r.content) for r in rows] == [
        ("Lantern Notes", 1, ""),
        ("Chapter 1", 2, "Low Water\n\nFog on the quay.\n\nRopes were wet."),
        ("1.1 Tides and Moorings", 3, "Knots by name."),
        ("Chapter 2: Open Sea", 2, "Past the light."),
        ("Intro ..... 3", 3, "Home by dusk."),
    ]
    assert [r.is_bold for r in rows] == [False, False, False, True, False] and rows[4].looks_like_toc_entry
    sizes = spark.createDataFrame([("rich", 11.0)], "doc_id string, body_size double")
    got = pdf.chapters(pdf.rich_chunks(s, sizes), profile).orderBy("group_no", "chunk_pos").collect()
    assert [(r.route, r.group_no, r.group_chapter_no, r.heading) for r in got] == [("rich", 1, 1, "Chapter 1"), ("rich", 1, 1, "1.1 Tides and Moorings"), ("rich", 2, 2, "Chapter 2: Open Sea")]


def test_body_sizes(spark):
    pages = [[(1, "a"), (2, "b")], [(3, "c"), (4, "d")]]
    s = frame(spark, ("d", pages))
    assert pdf.body_size_median(s).first().body_size == 3.0  # the upper one
    assert pdf.body_size_mode(s).first().body_size == 1.0  # of equals the first
    long = frame(spark, ("e", [[(10, "x")] * 120, [(30, "y")] * 300]))
    assert pdf.body_size_median(long, enough=100).first().body_size == 10.0
    assert pdf.profile(frame(spark, ("f", [[(11, "Index")], [(0.35, "ж" * 9)]]))).select("has_index", "encoding_ok", "type").first() == (True, False, "cjk-broken")


def test_sizes_are_rounded_as_binary_values(spark):
    s = frame(spark, *[(f"d{i}", [[(size, "ab")]]) for i, size in enumerate((0.35, 0.25, 11.05, 9.96))])
    want = {f"d{i}": round(v, 1) for i, v in enumerate((0.35, 0.25, 11.05, 9.96))}
    assert {r.doc_id: r.body_size for r in pdf.profile(s).collect()} == want == {"d0": 0.3, "d1": 0.2, "d2": 11.1, "d3": 10.0}
    assert {r.doc_id: r.body_size for r in pdf.body_size_mode(s).collect()} == want


def test_flags_make_bold_and_images_are_left_out(spark):
    s = frame(spark, ("d", [[(20, "Head", "Serif", 2), (11, "body")]])).unionByName(spark.createDataFrame([("d", 0, 9, 0, 0, 1, "image", 40.0, "Serif", 0)], books.SPAN))
    rows = pdf.blocks(s).orderBy("block_no").collect()
    assert [(r.text, r.is_bold) for r in rows] == [("Head", True), ("body", False)]
    assert pdf.line_markdown(frame(spark, ("e", [[(22, "Head"), (11, "a"), (11, "b\nc")]]))).first().markdown == "# Head\n\na\n\nb\n\nc\n"


def test_drawings(spark):
    box = "doc_id int, page_no int, block_no int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    b = spark.createDataFrame([(1, 0, 0, (0.0, 0.0, 10.0, 10.0)), (1, 0, 1, (0.0, 100.0, 10.0, 110.0)), (1, 1, 2, (0.0, 0.0, 10.0, 10.0))], box)
    d = spark.createDataFrame([(1, 0, (20.0, 5.0, 40.0, 30.0))], "doc_id int, page_no int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.block_no for r in pdf.near_drawings(b, d).collect()] == [0]


def article_of(spark, text):
    return article.sections(article.headings(article.strip_junk(lines(spark.createDataFrame([("doc", text)], "doc_id string, text string"))))).orderBy("group_no").collect()


def test_article_sections(spark):
    text = "A title\n \nABSTRACT\nabout\n12\nEuropean Journal of X\n- 3 -\n1. Model design\nbody\n1. Model design\nstill\nCONCLUSION:\nend\n2. The running text\nAppendixA\nlast"
    got = article_of(spark, text)
    assert [(r.heading, r.group_chapter_no, r.content) for r in got] == [
        ("Front Matter", 1, "A title"), ("ABSTRACT", 2, "about"), ("1. Model design", 3, "body\n1. Model design\nstill"), ("CONCLUSION", 4, "end\n2. The running text"), ("AppendixA", 5, "last"),
    ]
    assert [r.group_chapter_no for r in article_of(spark, "INTRODUCTION\na\nRESULTS\nb\nSUMMARY\nc")] == [1, 3, 4]
    bare = article_of(spark, "no headings\nhere")
    assert [(r.heading, r.content, r.group_chapter_no) for r in bare] == [("doc", "no headings\nhere", 1)]
    many = "\n".join(["1. Model design"] + [f"line {i} text" for i in range(600)])
    assert [r.heading for r in article_of(spark, many)] == ["doc"]


def test_documents_keep_to_themselves(spark):
    rng = random.Random(3)
    texts = {f"d{i}": "\n".join(rng.choice(["ABSTRACT", "1. Model design", "text", "RESULTS", "7"]) for _ in range(12)) for i in range(30)}
    whole = article.sections(article.headings(article.strip_junk(lines(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))))).collect()
    for name in ("d3", "d17"):
        alone = article.sections(article.headings(article.strip_junk(lines(spark.createDataFrame([(name, texts[name])], "doc_id string, text string"))))).collect()
        assert sorted(r for r in whole if r.doc_id == name) == sorted(alone)


def test_fallback_chain_and_metadata(spark):
    plain = [[(11, "INTRODUCTION"), (11, "Body of the article."), (11, "CONCLUSION"), (11, "End.")]]
    low = [[(18, "Big words here"), (11, "b1"), (11, "b2"), (11, "b3")]] + [[(11, "x")]] * 40
    s = frame(spark, ("rich", books.RICH), ("art", plain), ("low", low))
    m = spark.createDataFrame([("rich", "rich", "", "Holt, Mira", "D:2019", None, None), ("art", "art", "art", "A, B; C", None, "D:20210101", "de"), ("low", "low", "Low", None, None, None, None)], S.META)
    found, chunks = S.read_spans(s, m)
    routes = {r.doc_id: r.route for r in chunks.select("doc_id", "route").distinct().collect()}
    assert routes["art"] == "article" and routes.get("low") == "lowscore"
    b = {r.doc_id: r for r in found.collect()}
    assert (b["art"].authors, b["art"].language, b["art"].year) == (["B A", "C"], "de", 2021)
    assert b["art"].title == "INTRODUCTION Body of the article. CONCLUSION"
    assert (b["low"].title, b["low"].id) == ("Low", "low")
    assert {r.route for r in S.read_spans(s, m, "rich")[1].collect()} <= {"rich"}
    assert {r.route for r in S.read_spans(s, m, "article")[1].collect()} == {"article"}


def test_titles(spark):
    df = lines(spark.createDataFrame([(1, "Deep Nets\nfor All of Us Today\nJohn Ronald Smith\nmore"), (2, "DOI: 12\nx"), (3, "A Study\nshort\nrest of it")], "doc_id int, text string"))
    assert {r.doc_id: r.title for r in article.title(article.strip_junk(df)).collect()} == {1: "Deep Nets for All of Us Today", 2: None, 3: "A Study"}
