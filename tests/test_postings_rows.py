"""A row's postings are made where the row is: rows with keys of their own are not shuffled for it, and shared keys still meet."""

from lectern.operators import postings


def test_rows_with_own_keys_are_not_shuffled(spark):
    table = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (None, "lost"), (4, "Été été x_y")], "id long, text string")
    made = postings.postings(table, key="id", text="text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["term"], r["key"], r["positions"]) for r in made.collect()) == sorted(
        [("", k, []) for k in (1, 2, 3, 4)] + [("a", 1, [1]), ("b", 1, [0, 2]), ("x", 4, [2]), ("y", 4, [3]), ("été", 4, [0, 1])]
    )


def test_portions_and_shared_string_keys(spark, monkeypatch):
    monkeypatch.setattr(postings, "PORTION", 64)
    rows = [(f"k{i % 7}", " ".join(f"w{(i * j) % 5}" for j in range(i % 9))) for i in range(40)]
    want = {}
    for k, t in rows:
        want.setdefault(("", k), set())
        for at, w in enumerate(t.split()):
            want.setdefault((w, k), set()).add(at)
    got = postings.postings(spark.createDataFrame(rows, "id string, text string"), key="id", text="text").collect()
    assert {(r["term"], r["key"]): r["positions"] for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
