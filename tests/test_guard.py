"""The library without its corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout
    return [set(x.split()) for x in out.strip().split("\n")]


def test_entry_with_and_without_corpus_operators(tmp_path):
    whole, _ = names(ROOT) if os.path.isdir(f"{ROOT}/storyloom/llm") else (set(), None)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    rest, sql = names(tmp_path / "copy")
    assert len(rest) > 50 and sql <= rest and not any(x.startswith("op") and x[2].isdigit() for x in rest)
    assert not whole or (rest <= whole and "pipeline" in whole and {int(x[2:].split("_")[0]) for x in whole if x.startswith("op") and x[2:3].isdigit()} == set(range(1, 14)))
