import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from catalogue import agrees

from tallyforge.queries import catalogue

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, smallest, name):
    agrees(spark, smallest, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, smallest, name):
    df = catalogue.QUERIES[name](spark, smallest)  # these have no SQL
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_core_stands_alone(tmp_path):
    """Without the subpackage for text the entry point still offers the core."""
    shutil.copytree(REPO / "tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(x.startswith(('p7', 'p8', 'p9')) for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_the_text_operators():
    for f in (REPO / "tallyforge").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "tallyforge.llm" not in f.read_text(), f
