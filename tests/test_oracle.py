"""Every query with an SQL twin agrees with DuckDB, row for row."""

import duckdb
import pytest

from helpers import SF
from statloom.bindings import load
from statloom.bindings.tables import TABLES

QUERIES, ORACLE = load()
# Questions whose data needs the larger scale (too few groups, sparse cells) are asked there.
LARGER = {"gage_rr", "species_richness", "profile", "rcbd", "latin_square", "latin_square_anova"}


@pytest.fixture(scope="module")
def con():
    made = {}
    for sf in (SF, SF.replace("0.001", "0.01")):
        made[sf] = duckdb.connect()
        for t in TABLES:
            made[sf].sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(ORACLE, key=lambda n: (n in LARGER, n)))
def test_query(spark, con, name):
    sf = SF.replace("0.001", "0.01") if name in LARGER else SF
    df = QUERIES[name](spark, sf)
    got = sorted(tuple(map(repr, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    rel = con[sf].sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    ix = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(tuple(repr(r[i]) for i in ix) for r in rel.fetchall())
    assert got == want
