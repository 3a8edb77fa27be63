"""The contract: every query against its SQL on the small tables, and the entry module without the llm parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from termforge.plans import catalog
from verify import oracle_rows, spark_rows

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_is_what_sql_says(spark, sf_dir, name):
    names, rows = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.ORACLES:
        assert (names, rows) == oracle_rows(sf_dir, catalog.ORACLES[name])
    else:
        assert names and rows


def test_entry(spark):
    assert contract.entry(spark).columns == ["query_id", "doc_id", "score"]


def test_every_text_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_the_rest_works_without_the_llm_parts(tmp_path):
    for name in ("termforge", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "termforge/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(catalog.QUERIES)), "False", "True"], done.stderr
