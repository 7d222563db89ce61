import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_queries_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_extras(tmp_path):
    """The entry works where the subpackage, its tests and the pipeline are deleted."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path / "repo", capture_output=True, text=True, check=True).stdout.split()
    assert "expertise" in said and not any(n.startswith("op") or n == "pipeline" for n in said)


def test_other_import_errors_are_raised(tmp_path):
    """A missing wheel or a mistake in the subpackage isn't taken for its absence."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(root, "annalist"), tmp_path / "annalist", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import a_missing_wheel")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode and "a_missing_wheel" in said.stderr
