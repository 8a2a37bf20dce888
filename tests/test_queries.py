"""Every query with SQL gives the SQL's rows; what the entry module promises."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tidewatch.plans.registry import QUERIES, SQL

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, SMALL), SQL[name], SMALL)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_the_entry_query_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_the_library_runs_without_the_training_data_part():
    """The entry module imports, with all other queries, where the llm folder and its pipeline are missing."""
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("tidewatch.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "baseline" in e.queries() and not any(k.startswith("op") and k[2:3].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_part():
    for p in (ROOT / "tidewatch").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidewatch.llm" not in p.read_text(), p
