"""The entry point with and without the folders that may be deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q), set(o) <= set(q))"


def said(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.pyc"))
    with_file = said(copy)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said(copy) == with_file and with_file[2:] == ["False", "True"] and int(with_file[0]) > 150
