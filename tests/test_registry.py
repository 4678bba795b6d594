import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_module_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); assert len(q) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


GONE = """
import importlib.abc, sys

class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith({name!r}):
            raise ModuleNotFoundError(name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'p4_found' in e.queries() and 'p1_found' not in e.queries()
"""


def test_core_imports_without_the_subpackage():
    subprocess.run([sys.executable, "-c", GONE.format(name="shiori.llm")], cwd=REPO, check=True)


def test_nothing_outside_imports_the_subpackage():
    for path in (REPO / "shiori").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_flagship_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"query_id", "rank", "unit_seq", "score", "matched_terms"} == set(rows[0].asDict())
