"""The library without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("quarry/llm", "corpus_pipeline.py"), ("quarry/llm",), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    for name in ("quarry", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *[g.rsplit("/", 1)[1] for g in gone if "/" in g]))
        elif name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'pass_at_k' in q and set(s) <= set(q); print('pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "False"
