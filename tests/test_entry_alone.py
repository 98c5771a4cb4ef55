"""The entry loads without the corpus subpackage, with corpus_pipeline.py there or not."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from lodestone.operators import review as r
from lodestone.sources.tables import cut

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "hybrid_search" in names and set(e.oracle_sql()) <= names
assert "pipeline" not in names and not any(n.startswith("op1_") for n in names)
"""


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_corpus_folders(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from lodestone.llm.common import cut\n")
    made = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert made.returncode == 0, made.stderr


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})()})()

    with pytest.raises(ValueError):
        cut(Frame())


def test_reports_and_appends(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert r.markdown(rows, "Run") == "# Run\n\n| name | n |\n|-|-|\n| a\\|b | 1 |\n|  | 2 |\n"
    for _ in range(2):
        r.appended(rows, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4
