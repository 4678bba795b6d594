import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent

GONE = """
import importlib.abc, sys

class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == 'tiktoken':
            raise ModuleNotFoundError(name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__
"""


def test_a_library_the_subpackage_needs_must_not_be_missing():
    assert subprocess.run([sys.executable, "-c", GONE], cwd=REPO, capture_output=True).returncode
