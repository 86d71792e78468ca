"""Small books in every format."""

import io
import zipfile

FB2 = """<?xml version="1.0" encoding="utf-8"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info>
<author><first-name>Mira</first-name><last-name>Holt</last-name></author><book-title>Harbour Almanac</book-title><lang>en</lang><date>3 May 2021</date>
</title-info></description>
<body><section><title><p>Casting</p><p>Off</p></title><p>Plain <emphasis>soft <strong>loud</strong></emphasis> and <code>x=1</code> tail</p><empty-line/><subtitle>Note</subtitle>
<cite><p>Said</p><p>she</p></cite><poem><stanza><v>gone</v></stanza></poem>
<section><title><p>Rigging</p></title><p>Steps</p><section><p>Deep</p><section><title><p>Deeper</p></title><p>Deepest</p></section></section></section></section>
<section><p>No title here</p></section></body><body><section><p>notes</p></section></body></FictionBook>""".encode()


def epub(toc=(("First", "a.xhtml#x"), ("Again", "a.xhtml#y"), ("Lost", "none.xhtml"), ("", "b.xhtml"), ("Label only", "")), spine=("cover", "a", "b"), title="River Ledger"):
    nav = "".join(f'<navPoint id="n{i}"><navLabel><text>{t}</text></navLabel><content src="{h}"/></navPoint>' for i, (t, h) in enumerate(toc))
    files = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
        "OEBPS/book.opf": f"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title>
<dc:creator>Oren Vale and Ida Brook</dc:creator><dc:creator>Tess Marlow</dc:creator><dc:language>en</dc:language><dc:date>2023-05-01</dc:date></metadata>
<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>
<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="p.png" media-type="image/png"/></manifest>
<spine toc="ncx">{"".join(f'<itemref idref="{s}"/>' for s in spine)}</spine></package>""",
        "OEBPS/toc.ncx": f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{nav}</navMap></ncx>',
        "OEBPS/cover.xhtml": "<html><body><p>Cover</p></body></html>",
        "OEBPS/a.xhtml": "<html><head><title>no</title><style>p{}</style></head><body><h1>Heading A</h1><p>Intro <b>bold</b> &amp; <i>it</i></p><h2>Sec</h2><p>Text</p><ul><li>one</li><li>two</li></ul><h4>Low</h4><pre>code\n  kept</pre></body></html>",
        "OEBPS/b.xhtml": "<html><body><p>Before</p><h1>Heading B</h1><p>After</p></body></html>",
        "OEBPS/p.png": "x",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


SPAN = "doc_id string, page_no int, block_no int, line_no int, span_no int, block_type int, text string, size double, font string, flags int"


def spans(doc, pages):
    """pages: lists of blocks, each (size, text with a line each, font, flags)."""
    rows = []
    for p, blocks in enumerate(pages):
        for b, (size, text, *rest) in enumerate(blocks):
            font, flags = rest[0] if rest else "Serif", rest[1] if len(rest) > 1 else 0
            for n, line in enumerate(text.split("\n")):
                half = len(line) // 2
                rows += [(doc, p, b, n, s, 0, t, float(size), font, flags) for s, t in enumerate((line[:half], line[half:]))]
    return rows


RICH = [
    [(24, "Lantern Notes")],
    [(18, "Chapter 1\nLow Water"), (11, "Fog on the quay."), (11, "Ropes were wet."), (11, "12")],
    [(16, "1.1 Tides and Moorings\nlost line"), (11, "Knots by name."), (11, "Running | 7")],
    [(18, "Chapter 2: Open Sea", "Serif-Bold"), (11, "Past the light."), (15, "Intro ..... 3"), (11, "Home by dusk.")],
]
