import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Curation queries with an oracle, compared row by row on the small tables.
NAMES = sorted(set(entry._curation.ORACLES))


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "lineitem orders events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row]) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
