"""The entry points work without the training-data operators, whether or not the pipeline's file is still there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import __spark_entry__ as entry
names, twins = entry.queries(), entry.oracle_sql()
assert len(names) > 100 and set(twins) <= set(names)
assert not any(n == "pipeline" or n.startswith("op1") for n in names)
import bench, tests.oracle
assert set(bench.HEADLINE) <= set(names)
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline):
    away = {os.path.join(ROOT, "winnow", "llm"), os.path.join(ROOT, "tests", "llm"), os.path.join(ROOT, ".git")}
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: [n for n in names if os.path.join(d, n) in away or n == "__pycache__"])
    if not pipeline:
        os.remove(tmp_path / "repo" / "corpus_pipeline.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_with_everything():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() if os.path.isdir(os.path.join(ROOT, "winnow", "llm")) else True
