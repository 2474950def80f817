"""The entry point with and without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("gone", [("lacuna/llm", "tests/llm"), ("lacuna/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_optional_parts(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        path = tmp_path / "repo" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr
    n, sql, optional = run.stdout.split()
    assert int(n) >= int(sql) > 0 and optional == "False"
