"""The entry points, with and without the folders for training corpora."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT, SMALL

PROGRAM = f"""
import warnings
warnings.simplefilter("ignore")
import __spark_entry__ as entry
from evalweave.session import local_session
names = entry.queries()
assert len(names) > 100 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= set(names)
spark = local_session("entry", 2)
assert names["accuracy_by"](spark, "{SMALL}").count() > 0
spark.stop()
print("fine")
"""


@pytest.mark.parametrize("gone", [["evalweave/llm", "tests/llm"], ["evalweave/llm", "tests/llm", "corpus_pipeline.py"]])
def test_import_without_the_folders(tmp_path, gone):
    leave = {os.path.join(ROOT, x) for x in gone} | {os.path.join(ROOT, ".git")}
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if os.path.join(d, n) in leave])
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)},
                          capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
