"""The entry points without the text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"


def counted(folder: Path) -> list[int]:
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120, check=True)
    return list(map(int, done.stdout.split()))


def test_core_queries_stay_without_the_text_operators(tmp_path):
    from gridimpact.plans.queries import QUERIES

    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    shutil.copytree(ROOT / "gridimpact", copy / "gridimpact", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert counted(copy) == [len(QUERIES), 0]
    (copy / "gridimpact" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted folder may leave behind
    assert counted(copy) == [len(QUERIES), 0]
    (copy / "gridimpact" / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
    assert counted(copy) == [len(QUERIES), 0]
