"""The driver's entry, with the optional parts and without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("path", ["", str(ROOT)])
@pytest.mark.parametrize("gone", [["lexforge/llm", "tests/llm"], ["lexforge/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone, path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else Path.unlink)(copy / name) if (copy / name).exists() else None
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True).stdout.split()
    llm = (copy / "lexforge/llm").exists()
    assert int(out[0]) > 60 and out[1:] == ["True", "False", str(llm)]


def test_entry_whole():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(set(o) <= set(q), callable(e.entry))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split() == ["True", "True"]
