"""The entry module without a session, and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert said.returncode == 0, said.stderr
    lines = dict(x.split(" ", 1) for x in said.stdout.splitlines() if x.startswith(("NAMES", "SQL")))
    return set(lines["NAMES"].split()), set(lines["SQL"].split())


def test_entry_without_the_optional_part(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    queries, sql = names(tmp_path)
    assert "logic_groups" in queries and sql <= queries and not any(q.startswith("op1_") for q in queries)


def test_nothing_else_imports_it():
    for f in (ROOT / "sievework").rglob("*.py"):
        if "llm" not in f.parts:
            assert "sievework.llm" not in f.read_text(), f
