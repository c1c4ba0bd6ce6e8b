"""The driver's contract: every query of the engine runs, and equals its SQL."""

import duckdb
import pytest

from ledgerlake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
    if name in plans.oracle_sql():
        sql = plans.oracle_sql()[name].strip()
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        want = duck.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({sql})").fetchall()
        assert got == sorted(repr([plain(x) for x in r]) for r in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
