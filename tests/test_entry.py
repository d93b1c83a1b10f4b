"""The entry module works without the optional part."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E
from tests.conftest import ROOT

SCRIPT = """
import __spark_entry__ as E
names = set(E.queries())
assert not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert "suite_hallucination" in names and set(E.oracle_sql()) <= names
print(len(names), "pipeline" in names)
"""


@pytest.mark.parametrize("without", [("evalspark/llm", "tests/llm"), ("evalspark/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_optional_part(tmp_path, without):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(w) for w in without)))
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    rest = [n for n in E.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]
    assert run.stdout.split() == [str(len(rest)), "False"]


def test_no_other_module_imports_the_optional_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "evalspark")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "evalspark.llm" not in f.read(), name
