"""Passes over long runs, and the size of their expressions."""

from pyspark.sql import functions as F

from lectern.functions import bulgarian as B


def test_a_long_run_of_blanks_or_figures_takes_no_deep_stack(spark):
    """An executor ends when a task's stack overflows."""
    n = 20_000
    texts = {f"a 1{' ' * n}лв. b": "a един лев b", f"€ 1{' ' * n}b": "едно евро b", f"a {'0' * n}5 EUR b": "a пет евро b", f"1{' ' * n}-ви": "първи"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["said"] for r in B.spoken(rows, "t", "said").collect()} == texts


def test_an_ordinal_of_null_and_of_round_numbers(spark):
    rows = spark.createDataFrame([(None,), (1000,), (21000,), (10**6,), (10**6 + 5,), (-1000,)], "n long")
    got = {r["n"]: r["w"] for r in rows.select("n", B.ordinal(F.col("n"), "m").alias("w")).collect()}
    assert got == {None: None, 1000: "хиляден", 21000: "двадесет и еднахиляден", 10**6: "един милион", 10**6 + 5: "един милион пети", -1000: "минус хиляда"}


def test_numbers_below_a_hundred_are_those_of_the_long_way(spark):
    for g in "mfn":
        out = spark.range(100).select("id", B.two_figures(F.col("id"), g).alias("a"), B.cardinal(F.col("id"), g).alias("b")).collect()
        assert [r["a"] for r in out] == [r["b"] for r in out]


def test_all_passes_stay_a_small_plan(spark):
    """Each task unpacks the whole plan: executors hold it as often as they have tasks."""
    rows = spark.createDataFrame([("1",)], "t string")
    plan = B.spoken(rows, "t", "said")._jdf.queryExecution().optimizedPlan()
    bytes_ = spark._jvm.org.apache.spark.util.Utils.serialize(plan.expressions())
    assert len(bytes_) < 6_000_000
