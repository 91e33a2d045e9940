"""Readers of a document's JSON and text sidecar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<text:string,after:string,startMs:bigint,endMs:bigint>"
SYNC = f"version int, totalMs bigint, chunks array<struct<text:string,startMs:bigint,endMs:bigint,words:array<{WORD}>>>"
GEOMETRY = "version int, pages array<struct<i:int,w:double,h:double,rot:int,cropOffset:array<double>,lines:array<struct<b:array<double>,t:string,xs:array<double>>>>>"
#: Versions that can be read; a file of another one counts as missing.
SYNC_VERSIONS, GEOMETRY_LEAST = (1, 2), 3


def _versions(df: DataFrame, usable: Column) -> DataFrame:
    return df.withColumn("path", F.col("_metadata.file_path")).where(usable)


def sync_maps(spark: SparkSession, path: str) -> DataFrame:
    """A row per readable sync map: path, version, totalMs and chunks. Broken files have no version and go."""
    return _versions(spark.read.schema(SYNC).option("multiLine", True).json(path), F.col("version").isin(*SYNC_VERSIONS))


def cues(maps: DataFrame, keep: list[str]) -> DataFrame:
    """keep, seq and each chunk's text and times."""
    return maps.select(*keep, F.posexplode("chunks").alias("seq", "c")).select(*keep, "seq", "c.text", "c.startMs", "c.endMs", "c.words")


def geometry_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row per text line of readable page geometry: path, page, width, height, line and its box, text and edges."""
    files = _versions(spark.read.schema(GEOMETRY).option("multiLine", True).json(path), F.col("version") >= GEOMETRY_LEAST)
    pages = files.select("path", F.explode("pages").alias("p"))
    return pages.select("path", F.col("p.i").alias("page"), F.col("p.w").alias("width"), F.col("p.h").alias("height"), F.posexplode("p.lines").alias("line", "l")).select("path", "page", "width", "height", "line", F.col("l.b").alias("box"), F.col("l.t").alias("text"), F.col("l.xs").alias("edges"))


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words of TSV files: text, box, conf and line; rows without text or with conf under 0 go."""
    columns = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf"]
    schema = ", ".join(f"{c} double" for c in columns) + ", text string"
    rows = spark.read.schema(schema).options(sep="\t", header=True, quote="\u0000").csv(path)
    good = rows.where((F.col("conf") >= 0) & ~F.isnan("conf") & (F.trim("text") != ""))
    box = F.array("left", "top", F.col("left") + F.col("width"), F.col("top") + F.col("height"))
    line = (F.col("block_num") * 1_000_000 + F.col("par_num") * 1000 + F.col("line_num")).cast("long")
    return good.select(F.input_file_name().alias("path"), F.col("page_num").cast("int").alias("page"), F.trim("text").alias("text"), box.alias("box"), "conf", line.alias("line"))


def ocr_confidence(words: DataFrame, by: list[str], low: float = 60.0) -> DataFrame:
    """Mean confidence (0 to 1) and the share of words under `low`."""
    return words.groupBy(*by).agg((F.avg("conf") / 100).alias("confidence"), (F.count_if(F.col("conf") < low) / F.count("*")).alias("low_share"), F.count("*").alias("words"))


def paged_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path and text, line ends without blanks, trimmed; null if nothing is left."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    text = F.regexp_replace(F.regexp_replace("value", r"(?m)[ \t]+$", ""), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return files.select("path", F.when(text != "", text).alias("text"))


def feed_stories(spark: SparkSession, path: str, day: str, kind: str = "story") -> DataFrame:
    """Stories of a day in archives of the form `name = [..];`: of rows with one id the last, most points first."""
    body = F.regexp_extract("value", r"(?s)=\s*(\[.*\])\s*;?\s*$", 1)
    schema = "array<struct<id:bigint,type:string,time:bigint,title:string,score:bigint,dead:boolean>>"
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.from_json(body, schema)).alias("n", "s"))
    last = rows.groupBy("s.id").agg(F.max_by("s", F.struct("path", "n")).alias("s")).select("s.*")
    on_day = F.to_date(F.timestamp_seconds("time")) == F.lit(day).cast("date")
    return last.where(on_day & (F.col("type") == kind) & ~F.coalesce("dead", F.lit(False))).orderBy(F.desc("score"), "id")
