import pytest

from quire import cli
from quire.operators.meta import SchemaError, normalize
from quire.sinks.tree import read_tree, rendered, write_tree
from quire.sources import auto, epub, fb2, registry, vocabulary
from quire.sources.html_md import to_markdown
from quire.streaming.watch import watch

from . import books

FILES = "doc_id string, path string, content binary"


def test_fb2(spark):
    f = spark.createDataFrame([("1", "x/b.fb2", books.FB2), ("2", "bad.fb2", b"<no")], FILES)
    found, chunks = registry.reader("FB2")(f)
    rows = chunks.where("error is null").orderBy("group_no", "chunk_pos").collect()
    assert [(r.group_no, r.level, r.heading, r.content) for r in rows] == [
        (1, 1, "Casting Off", "Plain *soft **loud*** and `x=1` tail\n\n**Note**\n\n> Said she"),
        (1, 2, "Rigging", "Steps"), (1, 3, "", "Deep"), (1, 3, "Deeper", "Deepest"), (2, 1, "Chapter 2", "No title here"),
    ]
    b = {r.doc_id: r for r in found.collect()}
    assert (b["1"].title, b["1"].authors, b["1"].language, b["1"].year, b["1"].id) == ("Harbour Almanac", ["Mira Holt"], "en", 2021, "harbour-almanac")
    assert b["2"].title == "bad" and b["2"].error
    plain = fb2.plain_markdown(books.FB2)
    assert plain.startswith("## Casting Off\n\nPlain soft and x=1 tail\n\nSaid\n\nshe\n\n### Rigging\n\nSteps\n") and plain.endswith("No title here\n")
    with pytest.raises(ValueError, match="No <body> found"):
        fb2.plain_markdown(b'<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"/>')


def test_epub_by_toc_and_spine(spark):
    f = spark.createDataFrame([("t", "a/t.epub", books.epub()), ("s", "a/s.epub", books.epub(toc=(), title=" ")), ("z", "z.epub", b"no zip")], FILES)
    found, chunks = registry.reader("epub")(f)
    rows = chunks.orderBy("doc_id", "group_no", "chunk_pos").collect()
    t = [(r.group_no, r.chunk_pos, r.level, r.heading, r.content) for r in rows if r.doc_id == "t"]
    assert t == [
        (1, 0, 1, "First", "Intro **bold** & *it*"), (1, 1, 2, "Sec", "Text\n\n- one\n- two"), (1, 2, 3, "Low", "```\ncode\n  kept\n```"), (2, 0, 1, "Heading B", "Before\n\n\nAfter"),
    ]
    assert [(r.group_no, r.heading) for r in rows if r.doc_id == "s" and r.chunk_pos == 0] == [(1, "Chapter 1"), (2, "Heading A"), (3, "Heading B")]
    b = {r.doc_id: r for r in found.collect()}
    assert (b["t"].title, b["t"].authors, b["t"].language, b["t"].year) == ("River Ledger", ["Oren Vale", "Ida Brook", "Tess Marlow"], "en", 2023)
    assert b["s"].title == "s" and "z" not in b and [r.doc_id for r in rows if r.error] == ["z"]


def test_plain_extraction_by_extension(spark):
    f = spark.createDataFrame([("1", "x/b.fb2", books.FB2), ("2", "y.djvu", b"?"), ("3", "z.fb2", b"<a/>")], FILES)
    got = {r.doc_id: r for r in auto.markdown(f).collect()}
    assert got["1"].markdown and got["2"].error == "Unsupported format: djvu" and got["3"].error == "No <body> found in fb2"
    found = {r.doc_id: (r.id, r.title, r.authors, r.language) for r in auto.metadata(f).collect()}
    assert found == {"1": ("b", "Harbour Almanac", ["Mira Holt"], "en"), "2": ("y", "y", [], None), "3": ("z", "z", [], None)}


def test_broken_files_are_rows(spark):
    encrypted = bytearray(books.epub())
    at = encrypted.find(b"PK\x01\x02")
    while at >= 0:  # the flag of encryption, in every entry of the directory
        encrypted[at + 8] |= 1
        at = encrypted.find(b"PK\x01\x02", at + 4)
    f = spark.createDataFrame([("good", "g.epub", books.epub()), ("junk", "j.epub", b"no zip"), ("none", "n.epub", None), ("empty", "e.epub", b""), ("locked", "l.epub", bytes(encrypted))], FILES)
    found, chunks = registry.reader("epub")(f)
    assert {r.doc_id for r in chunks.where("error is not null").collect()} == {"junk", "none", "empty", "locked"}
    assert {r.doc_id for r in found.collect()} == {"good"} == {r.doc_id for r in chunks.where("error is null").collect()}
    f = spark.createDataFrame([("good", "g.fb2", books.FB2), ("junk", "j.fb2", b"<no"), ("none", "n.fb2", None)], FILES)
    found, chunks = registry.reader("fb2")(f)
    assert {r.doc_id for r in chunks.where("error is not null").collect()} == {"junk", "none"} == {r.doc_id for r in found.where("error is not null").collect()}
    assert {r.doc_id: r.error is None for r in auto.metadata(f).collect()} == {r.doc_id: r.error is None for r in auto.markdown(f).collect()} == {"good": True, "junk": False, "none": False}


def test_pdf_files_that_cannot_be_read_are_rows(spark, monkeypatch):
    from quire.sources import spans as S

    rows = books.spans("good", books.RICH) + [("bad", None, -1, -1, -1, S.ERROR, "FileDataError: no PDF", None, None, None)]
    s = spark.createDataFrame(rows, books.SPAN)
    meta = spark.createDataFrame([("good", "good", "", "", None, None, None), ("bad", "bad", None, None, None, None, None)], S.META)
    found, chunks = S.read_spans(s, meta)
    assert [(r.doc_id, r.error) for r in chunks.where("error is not null").collect()] == [("bad", "FileDataError: no PDF")]
    assert {r.doc_id for r in found.collect()} == {"good"}


def test_html():
    assert to_markdown("<p>a <b>b</b><script>x</script></p><img src=x><p>c<p>d") == "a **b**\n\nc\n\nd"
    assert to_markdown("<html><head><title>t</title></head><body><h2>H  x</h2><ol><li>1</li><li>2<ul><li>in</li></ul></li></ol></body>") == "## H x\n\n1. 1\n2. 2\n  - in"
    assert to_markdown('<a href="u">t</a><br>next') == "[t](u)\nnext" and to_markdown("") == ""


def test_html_tables():
    table = "<p>a</p><table><tr><th>H1</th><th>H <b>2</b></th></tr><tr><td>x<p>y</p></td><td><a href=u>z</a></td></tr></table>b"
    assert to_markdown(table) == "a\n\n| H1 | H **2** |\n| --- | --- |\n| x y | [z](u) |\n\nb"
    assert to_markdown("<table><tbody><tr><td>1<td>2<tr><td>3<td>4</table>") == "|  |  |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    assert to_markdown("<table><tr><td>1<table><tr><td>in</td></tr></table></td></tr>") == "|  |\n| --- |\n| 1 in |"
    assert to_markdown("<table></table>x") == "x"


def test_registry(spark):
    assert registry.supported() == ["epub", "fb2", "pdf"]
    with pytest.raises(ValueError, match=r"Unsupported format: doc \(supported: epub, fb2, pdf\)"):
        registry.reader("doc")


def tree(spark, folder):
    f = spark.createDataFrame([("1", "x/b.fb2", books.FB2)], FILES)
    found, chunks = registry.reader("fb2")(f)
    return write_tree(rendered(normalize(found), chunks.where("error is null")), str(folder))


def test_tree(spark, tmp_path):
    assert tree(spark, tmp_path) == 3
    book = tmp_path / "harbour-almanac"
    assert sorted(p.name for p in book.iterdir()) == ["00-book.md", "01-casting-off.md", "02-no-title-here.md"]
    text = (book / "01-casting-off.md").read_text()
    assert text.startswith("---\nbook_id: harbour-almanac\nchapter_no: 1\nchapter_title: Casting Off\nsequence: 1\n---\n\nPlain *soft")
    assert text.endswith("## Rigging\n\nSteps\n\nDeep\n\n### Deeper\n\nDeepest\n")
    (book / "09-old.md").write_text("old")
    tree(spark, tmp_path)
    assert (book / "09-old.md").exists()


def test_vocabulary(tmp_path):
    (tmp_path / "vocabulary.yaml").write_text("collections:\n  tech-lib:\n    domains: [dev, ops]\n    topics_registry: []\n")
    (tmp_path / "a/b").mkdir(parents=True)
    assert vocabulary.load(tmp_path / "a/b", "tech-lib") == (["dev", "ops"], [])
    with pytest.raises(SchemaError, match="no collection"):
        vocabulary.load(tmp_path, "none")
    with pytest.raises(SchemaError, match="has a vocabulary.yaml"):
        vocabulary.load(vocabulary.Path("/proc"), "tech-lib")


def test_cli(spark, tmp_path, capsys):
    book = tmp_path / "in.fb2"
    book.write_bytes(books.FB2)
    out = tmp_path / "lib"
    out.mkdir()
    (tmp_path / "vocabulary.yaml").write_text("collections:\n  lib:\n    domains: [dev]\n  tech-lib:\n    domains: [ops]\n")
    assert cli.main([str(book), "--dry-run"], spark) == 0
    assert "2 chapter(s), 5 chunk(s)" in capsys.readouterr().out
    assert cli.main([str(book), "-o", str(out)], spark) == 1 and not list(out.iterdir())
    assert cli.main([str(book), "-o", str(out), "-d", "nope"], spark) == 1
    assert "has: dev" in capsys.readouterr().err
    assert cli.main([str(book), "-o", str(out), "-d", "dev", "-t", "K8s Basics", "--edition", "2nd"], spark) == 0
    card = (out / "harbour-almanac/00-book.md").read_text()
    assert "- dev" in card and "- k8s-basics" in card and "edition: 2nd" in card
    assert cli.main([str(tmp_path / "none.fb2")], spark) == 1 and cli.main([str(book), "-f", "doc"], spark) == 1
    assert cli.main([str(book), "--dry-run", "-m", "odd"], spark) == 0 and cli.main([str(book), "-f", "pdf", "-m", "odd"], spark) == 1
    (tmp_path / "bad.fb2").write_bytes(b"<no")
    capsys.readouterr()
    assert cli.main([str(tmp_path / "*.fb2"), "-o", str(tmp_path / "two"), "-c", "tech-lib", "-d", "ops"], spark) == 1
    seen = capsys.readouterr()
    assert "bad.fb2: " in seen.err and "Wrote 3 file(s)" in seen.out and (tmp_path / "two/harbour-almanac/00-book.md").exists()


def test_stream(spark, tmp_path):
    for d in ("in", "out"):
        (tmp_path / d).mkdir()
    (tmp_path / "in/a.fb2").write_bytes(books.FB2)
    (tmp_path / "in/b.fb2").write_bytes(b"<no")
    places = str(tmp_path / "in"), "fb2", str(tmp_path / "out"), str(tmp_path / "state")
    with pytest.raises(SchemaError):
        watch(spark, *places, ["dev"], once=True)
    (tmp_path / "vocabulary.yaml").write_text("collections:\n  out:\n    domains: [dev]\n")
    watch(spark, *places, ["dev"], once=True).awaitTermination(120)
    assert (tmp_path / "out/harbour-almanac/00-book.md").exists()
    assert [r.doc_id.rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "out/_errors")).collect()] == ["b.fb2"]


def test_books_of_one_title_have_folders_of_their_own(spark, tmp_path):
    f = spark.createDataFrame([("1", "x/b.fb2", books.FB2), ("2", "y/c.fb2", books.FB2)], FILES)
    found, chunks = registry.reader("fb2")(f)
    assert write_tree(rendered(normalize(found), chunks), f"file://{tmp_path}", prune=True) == 6
    assert {p.name for p in tmp_path.iterdir()} == {"harbour-almanac", "harbour-almanac-2"}
    (tmp_path / "harbour-almanac/09-old.md").write_text("old")
    write_tree(rendered(normalize(found), chunks), str(tmp_path), prune=True)
    assert not (tmp_path / "harbour-almanac/09-old.md").exists() and len(list((tmp_path / "harbour-almanac-2").glob("*.md"))) == 3


def test_trees_are_written_by_many_tasks_and_read_without_a_listing_of_all(spark, tmp_path):
    n = 300
    files = spark.range(n).selectExpr("id as doc_id", "concat('b', id, '/00-book.md') as path", "concat('é', id) as body")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("tree", "tree")
    try:
        assert write_tree(files, f"file://{tmp_path}") == n
        (tmp_path / "b7/.01-part.md").write_text("unfinished")
        got = sorted(read_tree(files.selectExpr("concat('b', doc_id) as id"), f"file://{tmp_path}").collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted((f"b{i}/00-book.md", f"é{i}") for i in range(n))
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("tree") for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s]
    assert 4 <= max(tasks) <= 8  # not one task for few bytes, nor one a folder to list them


def test_a_lost_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        read_tree(spark.createDataFrame([("none",)], "id string"), str(tmp_path)).collect()


def test_tree_files_lists_no_files_in_one_process(spark):
    from quire.plans import queries

    assert "FileScan text" not in queries.tree_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
