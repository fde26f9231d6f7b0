"""The core stands without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ragstone.plans.catalog import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
LISTED = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [("ragstone/llm", "tests/llm"), ("ragstone/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without(tmp_path, gone):
    for part in ("ragstone", "tests"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
    for part in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    for part in gone:
        place = tmp_path / part
        shutil.rmtree(place) if place.is_dir() else place.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", LISTED], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    found, sql = (part.split() for part in said.stdout.strip().splitlines()[-1].split("|"))
    assert set(QUERIES) <= set(found) and set(ORACLE_SQL) <= set(sql) and "pipeline" not in found
    if "ragstone/llm" in gone:
        assert set(found) == set(QUERIES) and set(sql) == set(ORACLE_SQL)


def test_other_import_errors_are_raised(tmp_path, monkeypatch):
    (tmp_path / "broken_part.py").write_text("import a_module_that_is_nowhere\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError, match="nowhere"):
        entry._optional("broken_part")
