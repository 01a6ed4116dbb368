"""The driver's contract, with and without the parts that can be left out."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 60


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the synthetic tables are not here")
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "bucket" in df.columns


def test_it_imports_without_the_optional_part(tmp_path):
    for path in ROOT.iterdir():
        if path.name not in ("corpus_pipeline.py", "graphloom"):
            (tmp_path / path.name).symlink_to(path)
    (tmp_path / "graphloom").mkdir()
    for path in (ROOT / "graphloom").iterdir():
        if path.name != "llm":
            (tmp_path / "graphloom" / path.name).symlink_to(path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact_buckets' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
