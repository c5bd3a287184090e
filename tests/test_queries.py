"""Every query against its SQL twin on the smallest tables; those without SQL must run and keep their invariants."""

import duckdb
import pandas as pd
import pytest

from harborline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == float:
            frame[c] = frame[c].round(6)
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["supplier_id", "name", "score", "category"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
