"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[2]


@pytest.mark.parametrize("without", [["netlens/llm", "tests/llm", "corpus_pipeline.py"], ["netlens/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_other_parts(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet", "*.json", "*.md"))
    for part in without:
        at = copy / part
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'scan_vertical' in q and set(s) <= set(q); print(*sorted(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    names = out.stdout.split()
    assert "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == (len(without) == 1 and (copy / "netlens/llm").exists())
