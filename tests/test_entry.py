"""The library without the training-data operators: the entry imports, and the other queries are all there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from haulmark.catalog import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "haulmark", tmp_path / "haulmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False", "False"]
