"""The driver's contract, with and without the optional subpackage."""

import importlib.util
import subprocess
import sys

import __spark_entry__ as entry
from tidewater import catalog


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1000
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(sql) <= set(queries)


def test_nothing_else_needs_the_optional_subpackage():
    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('tidewater.llm') else f(n, *a); import __spark_entry__ as e; assert len(e.queries()) > 50; assert not [m for m in sys.modules if m.startswith('tidewater.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True)
    if importlib.util.find_spec("tidewater.llm"):
        assert {f"op{i}" for i in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
