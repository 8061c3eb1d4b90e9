"""The entry module, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "rank", "chunk_id", "document_id", "page_number", "document_path", "text", "origin", "confidence"]
    assert out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/lodestrata", tmp_path / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
