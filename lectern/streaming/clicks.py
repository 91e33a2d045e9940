"""Download clicks: one event for each request that a person made, appended to a table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def clicks(requests: DataFrame) -> DataFrame:
    """country, source and agent of each GET request, with the other columns; requests: method, url, country, referer, agent.

    The source is the address' ``from`` parameter, else the referer, else empty; an unknown country is ??. Other methods
    (link previews and scanners send HEAD) count nothing. Works on tables and on streams alike.
    """
    given = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*\?(?:[^#]*&)??from=([^&#]*)", 1)
    has = F.coalesce("url", F.lit("")).rlike(r"^[^?#]*\?(?:[^#]*&)?from=")
    source = F.when(has, F.coalesce(F.try_url_decode(given), given)).otherwise(F.coalesce("referer", F.lit("")))
    told = {"country": F.coalesce("country", F.lit("??")), "source": source, "agent": F.coalesce("agent", F.lit(""))}
    return requests.where("method = 'GET'").withColumns(told).drop("method", "url", "referer")


def append_clicks(requests: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream's clicks to Parquet at path, each once: the checkpoint remembers what is written."""
    writer = clicks(requests).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start(path)
