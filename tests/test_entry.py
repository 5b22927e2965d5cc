import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", ["nothing", "stale caches", "everything"])
def test_queries_without_the_llm_folders(tmp_path, left):
    """The entry point gives the other queries when the subpackage and the pipeline are gone, whatever folders they left."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "quern"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    if left != "everything":
        shutil.rmtree(tmp_path / "quern/llm", ignore_errors=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    if left == "stale caches":
        (tmp_path / "quern/llm/__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120).stdout.split()
    assert int(said[0]) > 80 and said[2] == "True" and (said[1] == "False" or left == "everything")
