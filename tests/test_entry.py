"""The entry module works without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder) -> list[str]:
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"
    env = os.environ | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_queries_without_the_training_data_operators(tmp_path):
    shutil.copytree(f"{ROOT}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    library = names(tmp_path)
    assert "bm25_topk" in library and "engine_answers" in library and not any(n.startswith("op") and n[2].isdigit() for n in library)
    (tmp_path / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting sources can leave
    assert names(tmp_path) == library
