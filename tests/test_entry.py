import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, ROOT)
    want = duck.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == sorted((tuple(row[i] for i in order) for row in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "doc_id", "score"]


@pytest.mark.parametrize("missing", ["public_tokenizers", "termloom.llm", "corpus_pipeline", "regex"])
def test_entry_without_an_optional_part(missing):
    """Whatever the training-data operators lack, the engine's queries are there."""
    block = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", block], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), check=True).stdout.split()
    assert int(said[0]) >= len(entry.catalog.queries()) and said[1] == "False"


def test_packages_export_their_api():
    from termloom import functions, operators, plans, sources, streaming

    for package in (functions, operators, plans, sources, streaming):
        assert package.__all__ and all(hasattr(package, name) for name in package.__all__)
