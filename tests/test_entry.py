"""The driver's entry, with and without the corpus part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("skyframe.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "find_grg" in e.queries() and "pipeline" not in e.queries() and not any(k.startswith("op") and "_" in k and k[2].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_imports_without_the_corpus_part():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_every_sql_belongs_to_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_corpus_part():
    for f in (ROOT / "skyframe").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f
