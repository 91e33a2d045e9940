"""Text of web pages, as a function over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text isn't read, and those that begin and end a line.
SKIPPED = ("script", "style", "noscript", "template", "head")
BLOCKS = ("p", "div", "br", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "blockquote", "pre")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipping = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipping += tag in SKIPPED
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skipping:
            self.skipping -= 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)


def text_of(html: str | None) -> str | None:
    """The visible text, a line per block, entities decoded once, no-break spaces as blanks; null for null."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.parts).replace("\xa0", " ").split("\n"))
    return "\n".join(line for line in lines if line)


def page_texts(df: DataFrame, *, html: str = "html", keep: list[str], name: str = "text") -> DataFrame:
    schema = df.select(*keep).schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return df.select(*keep, F.col(html).alias("__html")).mapInArrow(run, schema)
