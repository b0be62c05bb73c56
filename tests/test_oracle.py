"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for name in TABLES:
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return out


def rows(df):
    def plain(v):
        if v is None or str(v) in ("nan", "<NA>", "None"):
            return None
        return round(float(v), 6) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)]
    return sorted(([plain(v) for v in r] for r in df.itertuples(index=False, name=None)), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, float) for v in x) else x == y
