"""Operators with a DuckDB twin give the twin's rows."""

import duckdb
import pytest

from glyphlake.llm import queries


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 6) + 0.0 if isinstance(v, float) else v)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    result = con.execute(queries.ORACLES[name])
    expected = canonical([c[0] for c in result.description], result.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_each_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
