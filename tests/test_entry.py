"""The entry without its optional part."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from gridcast.plans import load_all

REPO = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("lost", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_optional_folders(tmp_path, lost):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(*lost, ".git", "__pycache__", "*.parquet"))
    assert not list(copy.rglob("llm"))
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, capture_output=True, text=True)
    queries, sql = load_all()
    assert out.stdout.split() == [str(len(queries)), str(len(sql))], out.stderr
