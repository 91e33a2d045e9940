"""Page ends are put in linear time, also where a text's last lines are long."""

import time

from lectern.operators import chunks
from lectern.plans import registry


def plain(text):
    lines = text.split("\n")
    return "".join(line + ("" if i == len(lines) - 1 else "\f" if i % 4 == 3 else "\n") for i, line in enumerate(lines))


def test_pages_of_long_and_short_lines(spark, tmp_path):
    texts = ["", "\n" * 9, "a b.\n" * 11, "one\n\ntwo\nthree. four\nfive\r\nsix\n\n\n\nseven", "a. " * 300 + "\n" + "b c. " * 500, "no line end " * 40_000, "x\n" * 6 + "word " * 60_000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {(r["doc_id"], r["seq"]): r.asDict() for r in registry.QUERIES["chunk_paged"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60
    want = {}
    for i, text in enumerate(texts):
        whole = plain(text or "")
        for seq, c in enumerate(chunks.drafts(whole, chunks.feed_pages(whole))):
            want[i, seq] = c | {"doc_id": i, "seq": seq}
    assert got == want
