"""Registered corpus queries: names, columns, and equality with DuckDB where SQL can express them."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from checks.compare import digest, duck
from devicelens.llm import registry


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    res = duck(sf).execute(registry.ORACLE_SQL[name])
    assert got == digest([c[0] for c in res.description], res.fetchall())


def test_nothing_else_imports_the_subpackage():
    """The library and its entry module work where the corpus folders are absent."""
    code = ("import sys\n"
            "class Absent:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('devicelens.llm', 'corpus_pipeline')):\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Absent())\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))\n")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-1:] == ["False"], out.stderr
