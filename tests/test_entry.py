"""The driver contract, with and without the optional subpackage."""

import importlib.util

import __spark_entry__


def test_twins_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark, monkeypatch):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "image_id", "score", "rank"]
    assert df.count() > 0


def test_without_the_subpackage(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("glyphlake.llm") else find(name, *a))
    names = __spark_entry__.queries()
    assert "flagship" in names
    assert not any(n.startswith("op1_") or n == "pipeline" for n in names)


def test_package_is_zipped_once():
    import zipfile

    path = __spark_entry__._ship("app")
    assert path == __spark_entry__._ship("app")
    assert "glyphlake/operators/search.py" in zipfile.ZipFile(path).namelist()
