"""Queries against their SQL on keys that the smallest tables do not reach."""

import duckdb
import pandas as pd

from lectern.plans import registry


def test_names_of_seven_digits_stay_in_the_order_of_their_keys(spark, tmp_path):
    keys = [999_999, 1_000_003, 1_000_014, 2_500_001, 9_000_002, 12_000_005, 100_007, 100_008, 5]
    orders = pd.DataFrame({"o_orderkey": keys * 2, "o_custkey": [1] * 9 + [2] * 9, "o_orderstatus": ["P", "F", "O"] * 6})
    orders.to_parquet(tmp_path / "orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = db.execute(registry.ORACLE_SQL["bilingual_readiness"]).df().sort_values("key").to_dict("records")
    got = registry.QUERIES["bilingual_readiness"](spark, str(tmp_path)).toPandas().sort_values("key").to_dict("records")
    assert got == want
