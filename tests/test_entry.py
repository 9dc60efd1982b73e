"""The entry works without the optional part, whether or not the pipeline's file is still there."""

import json
import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return json.loads(done.stdout.splitlines()[-1])


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_part(tmp_path, pipeline):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, copy, ignore=skip)
    queries, oracles = listed(copy)
    from docwarden.plans.chained import CHAINED
    from docwarden.plans.registry import QUERIES

    assert queries == sorted(QUERIES | CHAINED)
    assert set(oracles) <= set(queries)
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=600)
    assert collected.returncode == 0, collected.stdout + collected.stderr
