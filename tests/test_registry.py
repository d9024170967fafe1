import os
import pathlib
import shutil
import subprocess
import sys


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 90


def test_registry_loads_without_the_training_data_operators(tmp_path):
    root = pathlib.Path(__file__).resolve().parent.parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "tests", "spark-warehouse")
    for kept_pipeline in (True, False):
        copy = tmp_path / f"copy-{kept_pipeline}"
        shutil.copytree(root, copy, ignore=skip)
        if not kept_pipeline:
            (copy / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60, cwd=copy, env=os.environ | {"PYTHONPATH": ""})
        assert done.returncode == 0, done.stderr
        assert int(done.stdout.split()[-1]) > 90


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "rank", "fused_score"} <= set(rows[0].asDict())
