"""The library, its queries and its tests without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from pageframe.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_imports_without_training_data(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=skip)
    script = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    run = subprocess.run([sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split() == sorted(QUERIES)
    collect = [sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"]
    run = subprocess.run(collect, cwd=copy, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stdout
