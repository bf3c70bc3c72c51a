"""The driver's contract, with and without the parts that may be taken out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert {*s} <= {*q}; print(' '.join(q))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    return set(got.stdout.split())


def test_what_is_left_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests")
    shutil.copytree(ROOT, tmp_path / "rest", ignore=skip)
    rest, full = names(tmp_path / "rest"), names(ROOT)
    assert "discover_lpr" in rest and len(rest) >= 50
    assert rest <= full and not any(n.startswith("op") and n[2].isdigit() for n in rest) and "pipeline" not in rest


def test_nothing_else_imports_it():
    for folder, dirs, found in os.walk(os.path.join(ROOT, "glossade")):
        if os.path.basename(folder) == "llm":
            dirs.clear()
            continue
        for n in found:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "llm" not in f.read(), n
