"""The entry module with and without what the training-data operators need."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)


def _names(hidden: str) -> set[str]:
    code = f"""
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r} or name.startswith({hidden!r} + "."):
            raise ImportError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries())
print(" ".join(sorted(e.queries())))
"""
    return set(subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split())


def test_queries_without_the_training_data_operators():
    graph = _names("evigraph.llm")
    assert "degree" in graph and not any(n.startswith("op") for n in graph) and "pipeline" not in graph
    assert _names("zstandard") == graph
    assert "pipeline" not in _names("corpus_pipeline")
