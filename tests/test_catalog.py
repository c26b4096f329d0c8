"""Every registered query of the engine gives the rows of its SQL."""

from __future__ import annotations

import pytest
from _compare import comparable

from lodestrata.plans import catalog


def test_each_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, oracle, name):
    got = [r.asDict() for r in catalog.QUERIES[name](spark, data).collect()]
    want = oracle(catalog.ORACLES[name])
    assert comparable(got) == comparable(want)


def test_entry_imports_without_llm(monkeypatch, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[2]
    shutil.copytree(root / "lodestrata", tmp_path / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_latest' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
