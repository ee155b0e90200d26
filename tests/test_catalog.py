import duckdb
import pytest

from rasterloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    return sorted(repr(tuple(None if v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert canonical(map(tuple, df.select(*cols).collect())) == canonical(want)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
