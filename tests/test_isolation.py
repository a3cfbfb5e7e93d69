"""The engine without the subpackage of training-data operators."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.modules["siftwell.llm"] = None
import __spark_entry__ as e
names = e.queries()
assert names and names.keys() == e.oracle_sql().keys() and not any(n.startswith("op") or n == "pipeline" for n in names)
"""


def test_queries_without_the_subpackage():
    subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)
