"""E-books: text, documents and contents list of zipped XHTML, as functions over the bytes of files.

A book is one file, so one row of binary input; its blocks and contents entries come out as arrays of that row, from
which lectern.operators.ebooks cuts chapters for all books at once. Encrypted or over-large books, and files that
are no books, give a row with an error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import text_of

MOST_BYTES = 512 << 20
#: A contents document with fewer words of its own is not read.
NAV_WORDS = 50

# Tags that make blocks, that hold no text to read, and that have no end; kinds and roles of notes and print marks.
BLOCK_TAGS = set("address article aside blockquote body dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table td th tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SKIPPED_TAGS = set("head script style nav img svg math audio video object iframe map".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TYPES = set("pagebreak page-list noteref footnote footnotes endnote endnotes rearnote rearnotes note toc landmarks".split())
SKIPPED_ROLES = set("doc-pagebreak doc-pagelist doc-noteref doc-footnote doc-endnote doc-endnotes doc-toc doc-backlink".split())
PAGE_NUMBER = re.compile(r"[\s\-–—]*(?:\d{1,5}|(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))[\s\-–—]*")
NOTE_MARK = re.compile(r"[\s\[(]*[\d*†‡§¶]+[\s\])]*")
_INVISIBLE = re.compile("[\xad​⁠﻿]")


@dataclass
class Stream:
    """What is read of a book so far: blocks of text, where targets (file or file#id) begin, and documents (file, first block, heading)."""

    blocks: list[str] = field(default_factory=list)
    marks: dict[str, int] = field(default_factory=dict)
    documents: list[dict] = field(default_factory=list)


class _Walker(HTMLParser):
    """Adds a document's blocks to the stream: without notes, print marks and paragraphs that are a page number."""

    def __init__(self, file: str, targets: set[str], stream: Stream) -> None:
        super().__init__(convert_charrefs=True)
        self.file, self.targets, self.stream = file, targets, stream
        self.buffer = ""
        self.open: list[str] = []
        self.skip_from: int | None = None  # how deep the element is whose text is skipped
        self.headings = 0
        self.heading: list[str] | None = None  # the first heading's text while it is read
        self.first_heading: str | None = None
        self.links: list[tuple[int, int, int]] = []  # links that may be note marks: depth, blocks and buffer before them

    def flush(self) -> None:
        lines = (re.sub(r"\s+", " ", _INVISIBLE.sub("", line)).strip() for line in self.buffer.split("\n"))
        text = "\n".join(line for line in lines if line)
        self.buffer = ""
        if text and (self.headings or not PAGE_NUMBER.fullmatch(text)):
            self.stream.blocks.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID_TAGS:
            self.open.append(tag)
        if self.skip_from is not None:
            return
        have = {k: v or "" for k, v in attrs}
        target = f"{self.file}#{have.get('id', '')}"
        if have.get("id") and target in self.targets and target not in self.stream.marks:
            self.flush()
            self.stream.marks[target] = len(self.stream.blocks)
        kinds, roles = set(have.get("epub:type", "").lower().split()), set(have.get("role", "").lower().split())
        if tag in SKIPPED_TAGS or kinds & SKIPPED_TYPES or roles & SKIPPED_ROLES:
            if tag not in VOID_TAGS:
                self.skip_from = len(self.open)
            return
        if tag == "br":
            self.buffer += "\n"
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in HEADINGS:
            self.headings += 1
            if self.first_heading is None and self.heading is None:
                self.heading = []
        if tag == "a" and "#" in have.get("href", ""):
            self.links.append((len(self.open), len(self.stream.blocks), len(self.buffer)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            top, depth = self.open[-1], len(self.open)
            if self.skip_from is None:
                self._close(top, depth)
            elif depth == self.skip_from:
                self.skip_from = None
            self.open.pop()
            if top == tag:
                return

    def _close(self, tag: str, depth: int) -> None:
        if self.links and self.links[-1][0] == depth:
            _, blocks, at = self.links.pop()
            if blocks == len(self.stream.blocks) and NOTE_MARK.fullmatch(self.buffer[at:]):
                self.buffer = self.buffer[:at]
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in HEADINGS:
            self.headings -= 1
            if self.heading is not None:
                self.first_heading, self.heading = label("".join(self.heading)), None

    def handle_data(self, data: str) -> None:
        if self.skip_from is None:
            self.buffer += re.sub(r"\s+", " ", data)
            if self.heading is not None:
                self.heading.append(data)


class _Nav(HTMLParser):
    """The lists of a contents document's nav elements: (kinds, roles, entries), an entry being [parent, label or None, href or None]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.navs: list[tuple[set[str], set[str], list[list]]] = []
        self.inside = False
        self.items: list[int] = []
        self.labelled: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = {k: v or "" for k, v in attrs}
        if tag == "nav":
            self.navs.append((set(have.get("epub:type", "").lower().split()), set(have.get("role", "").lower().split()), []))
            self.inside, self.items = True, []
        elif self.inside and tag == "li":
            entries = self.navs[-1][2]
            entries.append([self.items[-1] if self.items else None, None, None])
            self.items.append(len(entries) - 1)
        elif self.inside and self.items and tag in ("a", "span") and self.labelled is None:
            entry = self.navs[-1][2][self.items[-1]]
            if entry[1] is None:
                entry[1], self.labelled = "", tag
                entry[2] = have.get("href") if tag == "a" else None

    def handle_endtag(self, tag: str) -> None:
        if tag == "nav":
            self.inside = False
        elif tag == "li" and self.items:
            self.items.pop()
        if tag == self.labelled:
            self.labelled = None

    def handle_data(self, data: str) -> None:
        if self.inside and self.items and self.labelled:
            self.navs[-1][2][self.items[-1]][1] += data


def label(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\[\d+\]", "", text or "")).strip()


def _named(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if e.tag.rpartition("}")[2].lower() == name.lower()]


def _target(base: str, href: str) -> str:
    """file or file#id of a link in the file base."""
    path, _, part = href.partition("#")
    file = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(path))) if path else base
    return f"{file}#{part}" if part else file


def nav_entries(markup: str, file: str) -> list[dict]:
    reader = _Nav()
    reader.feed(markup)
    reader.close()
    found = next((e for kinds, roles, e in reader.navs if "toc" in kinds or "doc-toc" in roles), None)
    if found is None:
        found = next((e for kinds, roles, e in reader.navs if not kinds and not roles), [])
    return [{"parent": p, "title": label(t), "target": _target(file, href) if href else None} for p, t, href in found]


def ncx_entries(markup: str, file: str) -> list[dict]:
    out: list[dict] = []

    def visit(node: ElementTree.Element, parent: int | None) -> None:
        for point in node:
            if point.tag.rpartition("}")[2].lower() == "navpoint":
                text = "".join(next(iter(e.itertext() for e in point if e.tag.rpartition("}")[2].lower() == "navlabel"), ""))
                src = next((e.get("src") for e in point if e.tag.rpartition("}")[2].lower() == "content"), None)
                out.append({"parent": parent, "title": label(text), "target": _target(file, src) if src else None})
                visit(point, len(out) - 1)

    for root in _named(ElementTree.fromstring(markup), "navMap")[:1]:
        visit(root, None)
    return out


class _Book:
    """A zipped book's package: its files in reading order and its contents documents."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        if sum(i.file_size for i in self.zip.infolist()) > MOST_BYTES:
            raise ValueError("the book is too large")
        opf = None
        if "META-INF/container.xml" in self.names:
            opf = next((e.get("full-path") for e in _named(ElementTree.fromstring(self.zip.read("META-INF/container.xml")), "rootfile")), None)
        opf = opf or next((n for n in sorted(self.names) if n.lower().endswith(".opf")), None)
        if opf is None:
            raise ValueError("no package file in the book")
        self.root = ElementTree.fromstring(self.zip.read(opf))
        items = {e.get("id"): (_target(opf, e.get("href", "")), e) for e in _named(self.root, "item") if e.get("id") and e.get("href")}
        self.order = [items[e.get("idref")][0] for e in _named(self.root, "itemref") if e.get("linear") != "no" and e.get("idref") in items]
        self.order = [f for f in self.order if f in self.names]
        if not self.order:
            raise ValueError("no document in the reading order")
        self.nav = next((f for f, e in items.values() if "nav" in e.get("properties", "").split()), None)
        spine = next(iter(_named(self.root, "spine")), None)
        ncx = items.get(spine.get("toc") if spine is not None else None)
        self.ncx = ncx[0] if ncx else next((f for f, e in items.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
        if "META-INF/encryption.xml" in self.names:
            locked = {_target("", e.get("URI", "")) for e in _named(ElementTree.fromstring(self.zip.read("META-INF/encryption.xml")), "CipherReference")}
            if locked & set(self.order):
                raise ValueError("the book is encrypted")

    def text(self, file: str | None) -> str:
        data = self.zip.read(file) if file in self.names else b""
        return data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace")


def read_book(content: bytes) -> tuple[Stream, list[dict]]:
    """The stream of a book and its contents entries (entry, parent, title, file, start), in the list's order."""
    book = _Book(content)
    entries = nav_entries(book.text(book.nav), book.nav) if book.nav else []
    if not entries and book.ncx and book.text(book.ncx):
        entries = ncx_entries(book.text(book.ncx), book.ncx)
    targets = {e["target"] for e in entries if e["target"]}
    stream = Stream()
    for file in book.order:
        start = len(stream.blocks)
        stream.marks.setdefault(file, start)
        walker = _Walker(file, targets, stream)
        walker.feed(book.text(file))
        walker.close()
        walker.flush()
        if file == book.nav and sum(len(b.split()) for b in stream.blocks[start:]) < NAV_WORDS:
            del stream.blocks[start:]
        else:
            stream.documents.append({"file": file, "start": start, "heading": walker.first_heading or None})
    out = []
    for i, e in enumerate(entries):
        file = e["target"].partition("#")[0] if e["target"] else None
        start = stream.marks.get(e["target"], stream.marks.get(file)) if e["target"] else None
        out.append({"entry": i, "parent": e["parent"], "title": e["title"], "file": file, "start": start})
    return stream, out


def chapters(content: bytes) -> list[tuple[int, str, str]]:
    """place, file and text of the book's files in reading order; books that can't be read raise ValueError."""
    book = _Book(content)
    texts = [(f, text_of(book.text(f)) or "") for f in book.order]
    return [(i, f, t) for i, (f, t) in enumerate((f, t) for f, t in texts if t.strip())]


_ERRORS = (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError)
_ENTRY = pa.struct([("entry", pa.int32()), ("parent", pa.int32()), ("title", pa.string()), ("file", pa.string()), ("start", pa.int32())])
_DOCUMENT = pa.struct([("file", pa.string()), ("start", pa.int32()), ("heading", pa.string())])
CONTENTS = "path string, blocks array<string>, documents array<struct<file:string,start:int,heading:string>>, entries array<struct<entry:int,parent:int,title:string,file:string,start:int>>, error string"


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """path, blocks, documents and contents entries of each book, and error instead for books that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    stream, entries = read_book(content.as_py())
                    row = (name, stream.blocks, stream.documents, entries, None)
                except _ERRORS as e:
                    row = (name, None, None, None, str(e) or type(e).__name__)
                types = (pa.string(), pa.list_(pa.string()), pa.list_(_DOCUMENT), pa.list_(_ENTRY), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["path", "blocks", "documents", "entries", "error"])

    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInArrow(run, CONTENTS)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """path, place, file, text of every document, and error instead for books that can't be read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, *c, None) for c in chapters(content)]
                except _ERRORS as e:
                    rows.append((name, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "place", "file", "text", "error"]).astype({"place": "Int64"})

    return files.mapInPandas(run, "path string, place long, file string, text string, error string")
