"""The driver contract, with the llm folders and without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "eventloom", tmp_path / "eventloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("eventloom/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_imports_with_an_empty_folder_left_behind(tmp_path):
    shutil.copytree(ROOT / "eventloom", tmp_path / "eventloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "eventloom" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
