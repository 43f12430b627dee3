"""Every library query runs, and equals its SQL where it has one."""

import math

import pytest

from assayer import queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    relation = duck.sql(SQL[name])
    columns = sorted(relation.columns)
    assert sorted(df.columns) == columns
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    picked = relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert ours == sorted((tuple(map(plain, r)) for r in picked), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
