"""The library stands without the llm subpackage, and nothing outside imports it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_only_the_entry_names_llm():
    for f in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "tessera").parts:
            assert "tessera.llm" not in f.read_text()


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
