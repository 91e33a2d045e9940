"""Components of long chains: right labels, and a plan whose expected size does not grow with the rounds."""

import random

from lectern.llm.components import components


def test_a_long_chain_is_one_component_and_its_expected_size_stays_that_of_its_rows(spark):
    ids = list(range(40))
    random.Random(3).shuffle(ids)
    links = spark.createDataFrame([*zip(ids[:30], ids[1:30]), *zip(ids[30:], ids[31:])], "a long, b long")
    found = components(components(links), "id", "component")  # a result may be what the next one starts from
    want = {i: min(part) for part in (ids[:30], ids[30:]) for i in part}
    assert {r["id"]: r["component"] for r in found.collect()} == want
    said = found._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert "E+" not in said and said.split(",")[0].split()[-1] in ("B", "KiB", "MiB"), said[:100]
