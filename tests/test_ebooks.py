"""E-books built as files: reading, contents lists and chapters."""

import io
import zipfile

import pytest

from lectern.operators import ebooks
from lectern.sources import epub

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def page(body):
    return f'<?xml version="1.0"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>not read</title><style>p {{}}</style></head><body>{body}</body></html>'


def book(docs, ncx=None, extra=None):
    """docs: (id, href, markup, properties of the item, attributes of the itemref)."""
    items = "".join(f'<item id="{i}" href="{h}" media-type="application/xhtml+xml" {p}/>' for i, h, _, p, _ in docs)
    spine = "".join(f'<itemref idref="{i}" {a}/>' for i, _, _, _, a in docs)
    if ncx:
        items += '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest>{items}</manifest><spine{" toc=" + chr(34) + "ncx" + chr(34) if ncx else ""}>{spine}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", opf)
        for _, href, markup, _, _ in docs:
            z.writestr(f"OEBPS/{href}", markup)
        if ncx:
            z.writestr("OEBPS/toc.ncx", ncx)
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


def doc(name, body, props="", attrs=""):
    return name, f"{name}.xhtml", page(body), props, attrs


NAV = 'properties="nav"'
PARTS = book([
    doc("cover", '<div><img src="images/cover.jpg" alt="Cover"/></div>'),
    doc("nav", """<h1>Contents</h1><nav epub:type="toc"><ol><li><a href="cover.xhtml">Cover</a></li>
        <li><a href="part1.xhtml">Part One</a><ol><li><a href="ch1.xhtml">Chapter 1: Arrival</a></li><li><a href="ch2.xhtml#start">Chapter 2: Departure</a></li></ol></li>
        <li><a href="notes.xhtml">Notes</a></li></ol></nav>
        <nav epub:type="page-list"><ol><li><a href="ch1.xhtml#p1">1</a></li></ol></nav><nav epub:type="landmarks"><ol><li><a href="ch1.xhtml">Start</a></li></ol></nav>""", NAV),
    doc("part1", '<section epub:type="part"><h1>Part One</h1></section>'),
    doc("ch1", """<h2>Chapter 1: Arrival</h2><p>It was a dark&nbsp;night<span epub:type="pagebreak" id="p1" title="1"/> and the rain fell.</p><p class="pagenum">2</p>
        <p>She read the letter<a epub:type="noteref" href="notes.xhtml#n1">1</a> twice, then a third time<a href="notes.xhtml#n2"><sup>[2]</sup></a>.</p>
        <span role="doc-pagebreak" id="p2">2</span><p>The ex\xadtraordinary house stood&#8212;silent.<br/>A second line.</p>
        <aside epub:type="footnote"><p>A footnote that is not read.</p></aside><p>xii</p>"""),
    doc("ch2", '<div id="start"><h2>Chapter 2: Departure</h2><p>They left at dawn<span epub:type="pagebreak" id="p3">3</span> without a word.</p></div>'),
    doc("notes", '<section epub:type="endnotes"><h2>Notes</h2><ol><li id="n1">A note.</li></ol></section>'),
])
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>
  <navPoint id="a"><navLabel><text>One</text></navLabel><content src="book.xhtml#c1"/></navPoint>
  <navPoint id="b"><navLabel><text>Two</text></navLabel><content src="book.xhtml#c2"/></navPoint>
  <navPoint id="c"><navLabel><text>Three</text></navLabel><content src="book%20end.xhtml"/></navPoint></navMap></ncx>"""
ANCHORS = book([
    doc("book", f'<p>{"preface " * 60}</p><h2 id="c1">One</h2><p>First body.</p><p>More of the first.<a id="c2"/>Second body starts mid-paragraph.</p>'),
    ("end", "book end.xhtml", page("<h2>Three</h2><p>Third body.</p>"), "", ""),
], NCX)
SECTIONS = book([
    doc("nav", '<nav epub:type="toc"><ol><li><a href="a.xhtml">Alpha</a><ol><li><a href="a.xhtml#s1">Alpha section</a></li></ol></li><li><a href="b.xhtml">Beta</a></li></ol></nav>', NAV),
    doc("a", '<h1>Alpha</h1><p>Intro.</p><h2 id="s1">Alpha section</h2><p>Section text.</p>'), doc("b", "<h1>Beta</h1><p>Beta text.</p>"),
])
PLAIN = book([doc("a", "<h1>Opening</h1><p>First.</p>"), doc("b", "<p>Untitled second.</p>"), doc("popup", "<p>Auxiliary content.</p>", "", 'linear="no"')])
ONLY = book([doc("only", f'<nav epub:type="toc"><ol><li><a href="#a">First</a></li><li><a href="#b">Second</a></li></ol></nav><section id="a"><h1>First</h1><p>{"w " * 40}</p></section><section id="b"><h1>Second</h1><p>{"w " * 40}</p></section>', NAV)])
LISTED = book([
    doc("nav", """<nav epub:type="toc"><ol><li><a href="text.xhtml#toc">Contents</a></li><li><a href="text.xhtml#c1">CHAPTER I. The Harbour</a></li>
        <li><a href="text.xhtml#c2">CHAPTER II. The Hill</a></li><li><a href="text.xhtml#c3">CHAPTER III. The House[1]</a></li></ol></nav>""", NAV),
    doc("text", """<h2 id="toc">Contents</h2><p>CHAPTER I. The Harbour</p><p>CHAPTER II. The Hill</p><p>CHAPTER III. The House</p>
        <h2 id="c1">CHAPTER I. The Harbour</h2><p>Boats.</p><h2 id="c2">CHAPTER II. The Hill</h2><p>Grass.</p><h2 id="c3">CHAPTER III. The House</h2><p>Walls.</p>"""),
])
LOCK = '<encryption xmlns:enc="http://www.w3.org/2001/04/xmlenc#"><enc:EncryptedData><enc:CipherData><enc:CipherReference URI="OEBPS/{}"/></enc:CipherData></enc:EncryptedData></encryption>'
FONTS = book([doc("a", "<h1>Only</h1><p>Readable.</p>")], extra={"META-INF/encryption.xml": LOCK.format("fonts/serif.otf")})
LOCKED = book([doc("a", "<p>scrambled</p>")], extra={"META-INF/encryption.xml": LOCK.format("a.xhtml")})


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    files = {"parts": PARTS, "anchors": ANCHORS, "sections": SECTIONS, "plain": PLAIN, "only": ONLY, "listed": LISTED, "fonts": FONTS, "locked": LOCKED, "nozip": b"%PDF-1.4", "empty": book([])}
    for name, content in files.items():
        (folder / f"{name}.epub").write_bytes(content)
    read = epub.read_contents(spark, str(folder))
    errors = {r["path"].rpartition("/")[2][:-5]: r["error"] for r in read.where("error IS NOT NULL").collect()}
    chapters = {}
    for r in ebooks.chapters(*ebooks.of_books(read.where("error IS NULL"))).orderBy("book", "chapter").collect():
        chapters.setdefault(r["book"].rpartition("/")[2][:-5], []).append((r["title"], r["text"]))
    return chapters, errors


def test_parts_are_opened_and_notes_and_print_marks_go(found):
    assert found[0]["parts"] == [
        ("Chapter 1: Arrival", "Part One\n\nChapter 1: Arrival\n\nIt was a dark night and the rain fell.\n\nShe read the letter twice, then a third time.\n\nThe extraordinary house stood—silent.\nA second line."),
        ("Chapter 2: Departure", "Chapter 2: Departure\n\nThey left at dawn without a word."),
    ]


def test_anchors_cut_within_a_file_and_long_front_matter_stays(found):
    assert [t for t, _ in found[0]["anchors"]] == ["Front matter", "One", "Two", "Three"]
    assert [x for _, x in found[0]["anchors"][1:]] == ["One\n\nFirst body.\n\nMore of the first.", "Second body starts mid-paragraph.", "Three\n\nThird body."]


def test_sections_in_their_chapters_file_do_not_cut(found):
    assert [t for t, _ in found[0]["sections"]] == ["Alpha", "Beta"] and "Section text." in found[0]["sections"][0][1]


def test_documents_are_chapters_without_a_contents_list(found):
    assert found[0]["plain"] == [("Opening", "Opening\n\nFirst."), ("Part 2", "Untitled second.")]
    assert found[0]["fonts"] == [("Only", "Only\n\nReadable.")]


def test_a_book_whose_contents_document_is_its_text(found):
    assert [t for t, _ in found[0]["only"]] == ["First", "Second"]


def test_a_printed_contents_page_goes(found):
    assert [t for t, _ in found[0]["listed"]] == ["CHAPTER I. The Harbour", "CHAPTER II. The Hill", "CHAPTER III. The House"]
    assert found[0]["listed"][0][1] == "CHAPTER I. The Harbour\n\nBoats."


def test_books_that_cannot_be_read_say_why(found):
    assert set(found[1]) == {"locked", "nozip", "empty"} and "encrypted" in found[1]["locked"]


def test_no_rows(spark):
    entries = spark.createDataFrame([], "book long, entry int, parent int, title string, file string, start int, opens int")
    blocks = spark.createDataFrame([(None, 0, "x")], "book long, block int, text string")
    documents = spark.createDataFrame([], "book long, start int, heading string")
    assert ebooks.chapters(entries, blocks, documents).count() == 0 and ebooks.boundaries(entries, blocks).count() == 0
    one = spark.createDataFrame([(5, 0, None)], "book long, start int, heading string")
    text = spark.createDataFrame([(5, 0, "Only text."), (5, 1, None)], "book long, block int, text string")
    assert [tuple(r) for r in ebooks.chapters(entries, text, one).collect()] == [(5, 1, "Part 1", "Only text.")]
