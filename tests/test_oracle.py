"""Every registered query against its SQL counterpart in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    # whole numbers with NULLs are floats with NaN in the one and a type of their own in the other
    ours, theirs = (x.astype({c: "float64" for c, kind in x.dtypes.items() if str(kind) == "Int64"}) for x in (ours, theirs))
    key = [sorted(ours.columns)]
    a = ours[key[0]].astype(str).sort_values(key[0]).reset_index(drop=True)
    b = theirs[key[0]].astype(str).sort_values(key[0]).reset_index(drop=True)
    assert len(a) > 0
    assert a.equals(b), a[a.ne(b).any(axis=1)].head()
