"""Every query of the library runs, and gives the rows of its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple("" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = db.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) == len(set(got.columns))
