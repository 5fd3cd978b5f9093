"""Every registered query against its DuckDB counterpart on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb

    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return out


def plain(rows, order):
    def cell(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.6g}"
        return "null" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_query_equals_sql(spark, con, name):
    found = QUERIES[name](spark, SF)
    expected = con.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(names)
    shared = sorted(names)
    assert plain(found.collect(), [found.columns.index(c) for c in shared]) == plain(expected.fetchall(), [names.index(c) for c in shared])


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith("op") and n != "pipeline"))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
