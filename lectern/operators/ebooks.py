"""Chapters of e-books by their contents lists: which level is the chapters', where books are cut, and what is left out.

Everything is joins, grouping and windows over the rows of all books; a window holds one book's
entries or pieces. Defined results: entries and blocks with a null book take no part; an entry without a place is passed over, its children are not; a
contents list that gives fewer than two places is not used: such a book has a chapter a document; a book
without blocks has no chapters; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import closure

#: Words of a part's own page, words of front matter, letters of a title, and lines that make a contents page.
LEAD, FRONT, TITLE, LISTED = 150, 50, 4, 3


def comparable(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def _counted(blocks: DataFrame) -> DataFrame:
    """blocks (book, block, text) with the book's words before each, and one past the last."""
    own = blocks.select("book", "block", _words(F.col("text")).cast("long").alias("n"))
    own = own.union(blocks.groupBy("book").agg((F.max("block") + 1).alias("block"), F.lit(0).cast("long").alias("n")))
    so_far = Window.partitionBy("book").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("book", "block", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))


def boundaries(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """book, start, title: where chapters begin. entries: (book, entry in the list's order, parent, title, file, start); blocks: (book, block, text).

    An entry whose children lie in other files, and whose own page is short, is opened into its children, and so is one without a place;
    any other entry is a chapter with all below it. At one place the later, more specific entry names the chapter.
    """
    e = entries.select("book", "entry", "parent", "title", "file", "start")
    child = e.select(F.col("book").alias("b"), F.col("parent").alias("p"), F.col("entry").alias("c"), F.col("file").alias("f"), F.col("start").alias("s")).where("p IS NOT NULL")
    of_children = child.groupBy("b", "p").agg(F.min_by(F.struct("s"), "c").alias("first"), F.collect_set(F.coalesce("f", F.lit(""))).alias("files"))
    before = _counted(blocks)
    e = e.join(of_children, (F.col("book") == F.col("b")) & (F.col("entry") == F.col("p")), "left").drop("b", "p")
    at = before.select(F.col("book").alias("b"), F.col("block").alias("at"), F.col("before").alias("x"))
    e = e.join(at, (F.col("book") == F.col("b")) & (F.col("start") == F.col("at")), "left").drop("b", "at")
    to = before.select(F.col("book").alias("b"), F.col("block").alias("at"), F.col("before").alias("y"))
    e = e.join(to, (F.col("book") == F.col("b")) & (F.col("first.s") == F.col("at")), "left").drop("b", "at")
    elsewhere = F.exists("files", lambda f: f != F.coalesce("file", F.lit("")))
    lead = F.greatest(F.coalesce(F.col("y") - F.col("x"), F.lit(0)), F.lit(0))
    e = e.withColumn("opens", F.col("files").isNotNull() & (F.col("start").isNull() | (elsewhere & (lead < LEAD))))
    tree = e.select(F.struct("book", "entry").alias("node"), F.when(F.col("parent").isNotNull(), F.struct("book", F.col("parent").alias("entry"))).alias("parent"))
    above = closure(tree, "node", "parent").where("depth > 0").select("ancestor", "node")
    shut = above.join(e.where("NOT opens").select(F.struct("book", "entry").alias("ancestor")), "ancestor").select("node.book", "node.entry").distinct()
    kept = e.where("start IS NOT NULL").join(shut, ["book", "entry"], "left_anti")
    named = F.max(F.when(F.coalesce("title", F.lit("")) != "", F.struct("entry", "title")))["title"]
    return kept.groupBy("book", "start").agg(F.coalesce(named, F.lit("")).alias("title"))


def _contents_pages(pieces: DataFrame, titles: DataFrame) -> DataFrame:
    """book, piece of pieces most of whose blocks begin with a chapter's title. pieces: (book, piece, block, text)."""
    t = titles.select(F.col("book").alias("b"), comparable(F.col("title")).alias("t")).where(F.length("t") >= TITLE).distinct()
    t = t.withColumn("head", F.substring("t", 1, TITLE))
    p = pieces.select("book", "piece", "block", comparable(F.col("text")).alias("k")).withColumn("head", F.substring("k", 1, TITLE))
    hit = p.join(t, (F.col("book") == F.col("b")) & (p["head"] == t["head"]) & F.startswith(F.col("k"), F.col("t")), "left_semi")
    listed = hit.groupBy("book", "piece").agg(F.count("*").alias("listed"))
    sizes = pieces.groupBy("book", "piece").agg(F.count("*").alias("size"))
    return listed.join(sizes, ["book", "piece"]).where((F.col("listed") >= LISTED) & (2 * F.col("listed") >= F.col("size"))).select("book", "piece")


def chapters(entries: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """book, chapter (from 1), title and text. documents: (book, start, heading), used where a book's contents list is not.

    Text before the first chapter is kept if it is long. A piece that only lists titles is emptied; a piece that is
    nothing but its own title is spoken at the start of the next.
    """
    found = boundaries(entries, blocks)
    usable = found.groupBy("book").count().where("count >= 2").select("book")
    listed = found.join(usable, "book", "left_semi")
    first = listed.groupBy("book").agg(F.min("start").alias("start"))
    front = first.join(_counted(blocks).withColumnRenamed("block", "start"), ["book", "start"]).where(F.col("before") >= FRONT)
    front = front.select("book", F.lit(0).alias("start"), F.lit("Front matter").alias("title"))
    by_document = documents.join(usable, "book", "left_anti")
    place = F.row_number().over(Window.partitionBy("book").orderBy("start"))
    by_document = by_document.select("book", "start", F.coalesce("heading", F.concat(F.lit("Part "), place)).alias("title"), F.lit(False).alias("by_list"))
    cuts = listed.select("book", "start", "title").unionByName(front).withColumn("by_list", F.lit(True)).unionByName(by_document)
    in_order = Window.partitionBy("book").orderBy("start")
    cuts = cuts.select("book", "start", "title", "by_list", F.row_number().over(in_order).alias("piece"), F.lead("start").over(in_order).alias("end"))
    # each block belongs to the last piece that begins at or before it: a merge of both orders
    marks = cuts.where(F.col("end").isNull() | (F.col("end") > F.col("start"))).select("book", F.col("start").alias("at"), F.lit(0).alias("kind"), "piece", "by_list", F.lit(None).cast("string").alias("text"))
    own = blocks.where("book IS NOT NULL").select("book", F.col("block").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("boolean").alias("by_list"), "text")
    so_far = Window.partitionBy("book").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    spread = marks.union(own).select("book", "at", "kind", "text", *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("piece", "by_list")])
    inside = spread.where("kind = 1 AND piece IS NOT NULL").select("book", "piece", "by_list", F.col("at").alias("block"), "text")
    inside = inside.join(_contents_pages(inside.where("by_list"), listed), ["book", "piece"], "left_anti")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    pieces = cuts.join(inside.groupBy("book", "piece").agg(parts.alias("parts")), ["book", "piece"], "left")
    bare = F.col("parts").isNull() | (comparable(F.array_join("parts", " ")) == comparable(F.col("title")))
    past = Window.partitionBy("book").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("bare", bare).withColumn("chapter", F.coalesce(F.count_if(~F.col("bare")).over(past), F.lit(0)) + 1)
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.coalesce("parts", F.array().cast("array<string>")).alias("parts")))), lambda x: x["parts"]))
    out = pieces.groupBy("book", "chapter").agg(texts.alias("texts"), F.max(F.when(~F.col("bare"), F.struct("piece", "title")))["title"].alias("title"), F.max(~F.col("bare")).alias("whole")).where("whole")
    title = T.trim(F.substring(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("texts")[0]), 1, 200))
    return out.select("book", F.col("chapter").cast("int").alias("chapter"), F.when(title != "", title).otherwise(F.concat(F.lit("Part "), "chapter")).alias("title"), F.array_join("texts", "\n\n").alias("text"))


def of_books(contents: DataFrame, book: str = "path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries, blocks and documents, as rows, of books read by lectern.sources.epub."""
    b = contents.withColumnRenamed(book, "book")
    entries = b.select("book", F.explode("entries").alias("e")).select("book", "e.*")
    blocks = b.select("book", F.posexplode("blocks").alias("block", "text"))
    return entries, blocks, b.select("book", F.explode("documents").alias("d")).select("book", "d.start", "d.heading")
