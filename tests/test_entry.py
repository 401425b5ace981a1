"""The driver's entry point works without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def names(folder) -> list[set[str]]:
    run = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return [set(line.split()) for line in run.stdout.splitlines()[-2:]]


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "checks", "watchloom"):
        source, target = os.path.join(REPO, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    queries, sql = names(tmp_path)
    assert "daily_summary" in queries and not any(q.startswith("op") or q == "pipeline" for q in queries)
    assert sql <= queries


def test_every_query_is_named_once():
    queries, sql = names(REPO)
    assert sql <= queries
