"""A job that is stopped, started again, and fed changed sources."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.streaming import jobs

KIND = "id long, text string, other string"


def put(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "text": t, "other": "x"}) for i, t in rows))


class Work:
    """Counts words; fails once at the named text."""

    def __init__(self, fails=None):
        self.fails, self.seen = fails, []

    def __call__(self, rows):
        here = rows.select("id", "text", jobs.HASH).collect()
        self.seen.append(sorted((r["id"] is not None, r["id"], r["text"]) for r in here))
        if self.fails and any(r["text"] == self.fails for r in here):
            self.fails = None
            rows.limit(1).select("id", jobs.HASH, F.lit(-1).alias("words")).write.mode("overwrite").parquet(f"{self.path}/batch={len(self.seen) - 1}")
            raise RuntimeError("stopped")
        return rows.select("id", jobs.HASH, F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("words"))


def run(spark, tmp, work, name="job"):
    work.path = f"{tmp}/{name}/out"
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp / "in"))
    query = jobs.run_incremental(stream, ["id"], ["text"], work, work.path, f"{tmp}/{name}/checkpoint", availableNow=True)
    query.awaitTermination()
    return query


def state(spark, tmp, name="job"):
    rows = jobs.latest(jobs.results(spark, f"{tmp}/{name}/out"), ["id"])
    return sorted(((r["id"], r["words"]) for r in rows.collect()), key=repr)


@pytest.fixture
def files(tmp_path):
    import os

    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a", [(1, "one"), (2, "one two"), (None, "a b c")])
    put(tmp_path / "in", "b", [(3, "x y"), (2, "one two"), (4, None), (5, "stop here")])
    put(tmp_path / "in", "c", [(1, "one more word"), (3, "x y"), (6, "z"), (6, "z z")])
    for n, name in enumerate("abc"):
        os.utime(tmp_path / "in" / f"{name}.json", (1000 + n * 10, 1000 + n * 10))
    return tmp_path


def test_a_stopped_job_goes_on_and_gives_the_rows_of_one_run(spark, files):
    work = Work(fails="stop here")
    with pytest.raises(Exception, match="stopped"):
        run(spark, files, work)
    assert len(work.seen) == 2
    run(spark, files, work)
    whole = Work()
    run(spark, files, whole, "whole")
    assert state(spark, files) == state(spark, files, "whole")
    assert dict(state(spark, files)) == {None: 3, 1: 3, 2: 2, 3: 2, 4: 1, 5: 2, 6: dict(state(spark, files))[6]}
    # the batch that was cut off is done again, those before it are not; rows with a known source are not redone
    assert work.seen[1] == work.seen[2] and [len(x) for x in work.seen] == [3, 3, 3, 2] and [len(x) for x in whole.seen] == [3, 3, 2]
    assert [tuple(r) for r in jobs.progress(jobs.results(spark, f"{files}/job/out"), ["id"]).orderBy("batch").collect()] == [(0, 3, 3), (1, 3, 6), (2, 2, 7)]


def test_only_changed_sources_are_redone(spark, files):
    run(spark, files, Work())
    put(files / "in", "d", [(1, "one more word"), (2, "now three words"), (7, "new")])
    again = Work()
    run(spark, files, again)
    assert again.seen == [[(True, 2, "now three words"), (True, 7, "new")]]
    assert dict(state(spark, files))[2] == 3


def test_nothing_to_read(spark, tmp_path):
    assert jobs.results(spark, f"{tmp_path}/none") is None
    (tmp_path / "in").mkdir()
    work = Work()
    run(spark, tmp_path, work)
    assert work.seen == []
