"""The entry without the training-data part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
for name in ({names!r}).split():
    sys.modules[name] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in e.queries()))
"""


def counts(names: str) -> list[str]:
    run = subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_entry_without_the_part():
    n, oracles, there = counts("tidebook.llm")
    assert int(n) > 100 and int(oracles) > 80 and there == "False"


def test_entry_without_a_library_of_the_part():
    assert counts("xxhash")[0] == counts("tidebook.llm")[0]
