"""The entry points work without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
print(len(names), any(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names, set(e.oracle_sql()) <= names)
"""


@pytest.mark.parametrize("hidden", [["loomseries/llm"], ["corpus_pipeline.py"], ["loomseries/llm", "corpus_pipeline.py"]])
def test_without_optional_parts(tmp_path, hidden):
    """A copy of the sources without them lists all other queries."""
    shutil.copytree(os.path.join(ROOT, "loomseries"), tmp_path / "loomseries", ignore=shutil.ignore_patterns("__pycache__", *[h.split("/")[-1] for h in hidden]))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in hidden and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, has_llm, has_pipeline, sql_fits = done.stdout.split()
    there = os.path.isdir(tmp_path / "loomseries" / "llm")
    assert int(count) > 200 and has_llm == str(there) and has_pipeline == "False" and sql_fits == "True"
