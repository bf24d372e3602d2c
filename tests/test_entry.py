"""The driver's contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_works_without_the_training_data_part(left, tmp_path):
    """The rest imports, and has its queries, where the subpackage is gone, with the pipeline's file or without it."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "palaver", tmp_path / "palaver", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'active_channels' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_what_can_be_imported_of_the_training_data_part_is_there(tmp_path):
    """Without the pipeline's file the operators stay; with an operator that cannot be imported the rest does."""
    root = Path(__file__).resolve().parents[1]
    if not (root / "palaver" / "llm").exists():
        pytest.skip("the part is not installed")
    shutil.copytree(root / "palaver", tmp_path / "palaver", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    run("import __spark_entry__ as e; q = e.queries(); assert 'op1_chat_format' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)")
    (tmp_path / "palaver" / "llm" / "sharding.py").write_text("import a_library_that_is_not_there\n")
    run("import __spark_entry__ as e; q = e.queries(); assert 'active_channels' in q and 'op1_chat_format' not in q")
