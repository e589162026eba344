"""The registered queries without the text operators."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("roomtide.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as registered
from oracles.catalog import CATALOG
assert registered.queries().keys() == registered.oracle_sql().keys() == CATALOG.keys()
"""


def test_text_operators_may_be_absent():
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", CODE], cwd=root, check=True, timeout=120)


def test_nothing_else_imports_the_text_operators():
    root = Path(__file__).resolve().parents[1]
    files = [p for p in root.rglob("*.py") if "llm" not in p.parts and p.name not in ("corpus_pipeline.py", "__spark_entry__.py")]
    assert files and not [p for p in files if "roomtide." + "llm" in p.read_text() and p != Path(__file__).resolve()]
