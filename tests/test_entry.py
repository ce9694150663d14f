import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


CODE = """
import __spark_entry__ as e
q = e.queries()
assert len(q) >= 115 and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(s).count() == 8 and q["patient_fusion"](s, "/root/testdata/sf0.001").count() > 0
"""


def copied(tmp_path, *without):
    for name in ("voxcohort", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    for name in without:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink()
    return {"PATH": os.environ["PATH"], "PYTHONPATH": str(tmp_path), **{k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "SPARK_HOME", "HOME")}}


@pytest.mark.parametrize("without", [("voxcohort/llm", "corpus_pipeline.py"), ("voxcohort/llm",)])
def test_the_rest_works_without_the_corpus_operators(tmp_path, without):
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, env=copied(tmp_path, *without), capture_output=True, timeout=300)


def test_a_broken_dependency_is_not_hidden(tmp_path):
    env = copied(tmp_path)
    (tmp_path / "voxcohort" / "llm" / "graph.py").write_text("import no_such_dependency\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert found.returncode and "no_such_dependency" in found.stderr
