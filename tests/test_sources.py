"""Readers, geometry and streams on small hand-made inputs."""

import json

import numpy as np

from lectern.operators import geometry
from lectern.sources import sidecars
from lectern.streaming import meter


def test_sidecars(spark, tmp_path):
    word = {"text": "a", "after": " ", "startMs": 0, "endMs": 5}
    for i, version in enumerate((1, 2, 9)):
        (tmp_path / f"s{i}.json").write_text(json.dumps({"version": version, "totalMs": 10, "chunks": [{"text": "a", "startMs": 0, "endMs": 10, "words": [word]}]}, indent=1))
    (tmp_path / "broken.json").write_text("{")
    maps = sidecars.sync_maps(spark, str(tmp_path / "*.json"))
    assert sorted(r["version"] for r in maps.collect()) == [1, 2]
    assert {(r["seq"], r["text"], r["endMs"]) for r in sidecars.cues(maps, ["path"]).collect()} == {(0, "a", 10)}
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "o.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t10\t20\t30\t5\t91.5\tHello\n5\t1\t1\t1\t1\t2\t50\t20\t30\t5\t-1\t\n5\t1\t1\t1\t1\t3\t50\t20\t30\t5\t40\t\"odd\n")
    words = sidecars.ocr_words(spark, str(tmp_path / "o.tsv"))
    assert [(r["text"], list(r["box"])) for r in words.orderBy("conf").collect()] == [('"odd', [50, 20, 80, 25]), ("Hello", [10, 20, 40, 25])]
    (r,) = sidecars.ocr_confidence(words, ["page"]).collect()
    assert r["low_share"] == 0.5 and r["words"] == 2
    (tmp_path / "p.txt").write_text("  \nline one  \nline two\fpage two \n\n")
    assert sidecars.paged_text(spark, str(tmp_path / "p.txt")).first()["text"] == "line one\nline two\fpage two"
    stories = [{"id": 1, "type": "story", "time": 86_400, "title": "old", "score": 5}, {"id": 1, "type": "story", "time": 86_500, "title": "new", "score": 7}, {"id": 2, "type": "story", "time": 86_400, "title": "two", "score": 9}, {"id": 3, "type": "job", "time": 86_400, "title": "job", "score": 99}]
    (tmp_path / "n.js").write_text("window.data = " + json.dumps(stories) + ";\n")
    assert [r["title"] for r in sidecars.feed_stories(spark, str(tmp_path / "n.js"), "1970-01-02").collect()] == ["two", "new"]


def test_columns(spark):
    left = [[10, y, 45, y + 4] for y in range(0, 50, 5)]
    right = [[55, y, 90, y + 4] for y in range(0, 50, 5)]
    boxes = np.array(left + right, float)
    assert list(geometry.reading_order(boxes, 100)) == [0] * 10 + [1] * 10
    assert geometry.column_cut(np.array([[10, y, 90, y + 4] for y in range(0, 50, 5)], float), 100) is None
    df = spark.createDataFrame([(1, i, [float(x) for x in b], 100.0) for i, b in enumerate(right + left)], "page int, line int, box array<double>, width double")
    assert [r["line"] for r in geometry.page_columns(df, ["page"]).orderBy("place").collect()] == [*range(10, 20), *range(10)]
    line = {"page": 1, "text": "abcd", "box": [0, 0, 40, 10], "edges": None}
    assert geometry.range_rects([line, line], 2, 6) == [(1, 20.0, 0, 20.0, 10), (1, 0.0, 0, 10.0, 10)]


def test_meter(spark, tmp_path):
    samples = []
    for at, done in ((0, 0), (0.1, 5), (20, 40), (40, 80)):
        samples = meter.add_sample(samples, at, done)
    assert meter.rate(samples) == 2.0 and meter.rate(meter.add_sample(samples, 1000, 90)) is None
    events = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 1, "late"), ("b", 1, "z")], "k string, token long, v string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = meter.fenced(stream, "k", "token").writeStream.format("memory").queryName("fenced").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination(120)
    assert sorted(r["v"] for r in spark.table("fenced").collect()) == ["y", "z"]
    ticks = spark.createDataFrame([("a", float(t), t * 2.0) for t in range(0, 60, 10)], "k string, t double, done double").selectExpr("k", "timestamp_seconds(t) AS at", "done")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    run = meter.throughput(stream, "k", "at", "done").writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    run.awaitTermination(120)
    assert spark.table("rates").orderBy("at").collect()[-1]["rate"] == 2.0


def test_books(spark, tmp_path):
    import zipfile

    from lectern.sources import epub

    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        z.writestr("OPS/b.opf", '<package xmlns="o"><manifest><item id="x" href="one%201.xhtml"/><item id="y" href="two.xhtml"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>')
        z.writestr("OPS/one 1.xhtml", "<html><body><h1>One</h1><p>first</p></body></html>")
        z.writestr("OPS/two.xhtml", "<html><body><p>second</p></body></html>")
    (tmp_path / "b.epub").write_bytes(b"not a zip")
    rows = epub.read_books(spark, str(tmp_path / "*.epub")).collect()
    assert [(r["file"], r["text"]) for r in sorted((r for r in rows if r["error"] is None), key=lambda r: r["place"])] == [("OPS/two.xhtml", "second"), ("OPS/one 1.xhtml", "One\nfirst")]
    assert sum(r["error"] is not None for r in rows) == 1


def test_contents(spark):
    from lectern.operators import contents

    heads = [{"text": t, "page": p} for t, p in (("The Long Road", 12), ("Notes", 13), ("A Second Start", 22), ("The Long Road", 90), ("An Ending Comes", 31))]
    entries = [{"title": t, "page": p} for t, p in (("The long road", 1), ("A second start", 11), ("An ending comes", 20), ("Missing part here", 25))]
    e = spark.createDataFrame([(1, i, x["title"], x["page"]) for i, x in enumerate(entries)], "u int, entry int, title string, page int")
    h = spark.createDataFrame([(1, i * 10, x["text"], x["page"]) for i, x in enumerate(heads)], "u int, block int, text string, page int")
    assert [r["heading"] for r in contents.locate_contents(e, h, "u").orderBy("entry").collect()] == [0, 20, 40, None]
    assert contents.salvage_json('ok:\n```json\n{"a": [1]}\n```') == {"a": [1]} and contents.salvage_json("so [1, 2] it is") == [1, 2] and contents.salvage_json("none") is None
