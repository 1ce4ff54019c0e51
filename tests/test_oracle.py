"""Every registered query against its SQL in another engine, on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from conftest import SMALL

duckdb = pytest.importorskip("duckdb")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
FITTED = {
    "dealer_segments", "segment_diagnostics", "segment_centres", "segment_profile", "segment_overview",
    "demand_forecast", "forecast_model_summary", "forecast_scores", "forecast_overview", "forecast_series",
    "dq_result_sanity",
}


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return None if isinstance(value, float) and math.isnan(value) else value

    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def test_every_query_but_the_fits_has_sql():
    assert set(entry.core_queries()) - set(entry.core_sql()) == FITTED


@pytest.mark.parametrize("name", sorted(entry.core_sql()))
def test_same_rows(spark, other, name):
    df = entry.queries()[name](spark, SMALL)
    relation = other.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert _rows(df.columns, df.collect()) == _rows(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 150


BLOCKED = """
import importlib.abc, sys
sys.path.insert(0, {root!r})
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {library!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
assert entry.llm_queries is None and set(entry.queries()) == set(entry.core_queries())
"""


@pytest.mark.parametrize("library", ["tokenizers", "regex", "public_tokenizers", "corpus_pipeline"])
def test_a_missing_library_leaves_the_core(library):
    root = str(Path(entry.__file__).resolve().parent)
    subprocess.run([sys.executable, "-c", BLOCKED.format(root=root, library=library)], check=True, timeout=120)
