"""The entry module imports and answers without the training-data package."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), *sorted(q))"


@pytest.mark.parametrize("without", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_package(tmp_path, without):
    ignore = shutil.ignore_patterns("tests", ".git", "__pycache__", *without)
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, *names = out.stdout.split()
    assert int(n) > 100 and int(sql) > 90
    assert not [x for x in names if x == "pipeline" or x.startswith("op") and x[2:3].isdigit()]
