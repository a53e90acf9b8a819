"""The driver's contract, with and without the optional parts."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_names_and_sql_agree(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    out = e.entry(spark)
    assert out.columns == ["query_id", "id", "score", "rank"] and out.count() == 40 * 5


def test_library_stands_without_subpackages():
    """Nothing of the rest imports the folder that can be left out."""
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path


def test_entry_without_the_optional_parts(tmp_path):
    """In a copy without them; a third-party module that is missing is an error, not a reason to leave queries out."""
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
