"""The contract stands without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'knn_exact_cosine' in q; print(sum(n.startswith('op') for n in q), 'pipeline' in q)"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)


def test_queries_are_listed_without_a_session_and_without_optional_parts(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(tmp_path / "r" / "vicinal" / "llm", ignore_errors=True)
    (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    got = run(tmp_path / "r")
    assert got.returncode == 0 and got.stdout.split()[-2:] == ["0", "False"], got.stderr


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    (tmp_path / "r" / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in run(tmp_path / "r").stderr
