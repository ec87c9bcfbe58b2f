"""Every query of the place engine against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from terrane.plans import queries as place

SMALL = "/root/testdata/sf0.001"


def rows(frame):
    """Rows as sorted text: floats to nine digits, nulls alike."""

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return "-"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET memory_limit = '3GB'")
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(place.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = place.QUERIES[name](spark, SMALL).toPandas(), duck.execute(place.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
