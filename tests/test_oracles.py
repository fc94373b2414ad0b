"""Every registered query with a DuckDB twin gives the twin's rows."""

import duckdb
import pytest

from glyphlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 6) + 0.0 if isinstance(v, float) else v)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    result = duck.execute(catalog.ORACLES[name])
    expected = canonical([c[0] for c in result.description], result.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_twins_are_registered():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
