"""The entry with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from echoframe.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_operators_folder(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "echoframe"), tmp_path / "echoframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if pipeline:  # left behind, it must not be in the way
        (tmp_path / "corpus_pipeline.py").write_text("from echoframe.llm import queries\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True).stdout
    assert told.split() == [str(len(registry.PLANS)), str(len(registry.ORACLES)), "False"]


def test_a_broken_operator_is_not_swallowed(tmp_path):
    shutil.copytree(os.path.join(ROOT, "echoframe"), tmp_path / "echoframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "echoframe" / "llm").mkdir()
    (tmp_path / "echoframe" / "llm" / "__init__.py").write_text("")
    (tmp_path / "echoframe" / "llm" / "queries.py").write_text("import no_such_module\n")
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.returncode != 0 and "no_such_module" in told.stderr
