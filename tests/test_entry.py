"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_rest_works_without_llm(tmp_path):
    (tmp_path / "lodestack").mkdir()
    for p in (ROOT / "lodestack").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "lodestack" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for p in (ROOT / "lodestack").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lodestack.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
