"""Every catalogue query against its oracle SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from stepwright.plans import catalogue, oracles


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def norm(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
        return str(float(v)) if type(v).__name__ == "Decimal" else v

    return sorted([tuple(cell(float(v)) if type(v).__name__ == "Decimal" else cell(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_oracle(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    rel = con.execute(oracles.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert norm(map(tuple, got.select(*cols).collect())) == norm(rel.fetchall())
