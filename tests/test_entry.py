"""The library works without the text operators, whatever is left of them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CHECK = """
import __spark_entry__ as entry
from skyledger.session import build_session
queries, sql = entry.queries(), entry.oracle_sql()
assert len(queries) > 150 and set(sql) <= set(queries) and not any(k.startswith("op") and k[2].isdigit() for k in queries) and "pipeline" not in queries
print("rows", queries["monthly_disruption"](build_session("entry", "local[2]", 2), "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("also_gone", [["corpus_pipeline.py"], []])
def test_without_the_text_part(tmp_path, also_gone):
    skipped = {"llm", ".git", "__pycache__", ".pytest_cache", *also_gone}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda _, names: skipped & set(names))
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows" in done.stdout
