"""The driver contract holds without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_operators(tmp_path):
    away = ("llm", ".git", "corpus_pipeline.py", "__pycache__")
    for gone in (away, away[:2] + away[3:]):  # with and without the pipeline's own file
        copy = tmp_path / str(len(gone))
        shutil.copytree(ROOT, copy, ignore=lambda d, names, gone=gone: [n for n in names if n in gone])
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(s) <= set(q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 190 and out[1:] == ["0", "True"]
