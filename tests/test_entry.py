"""The driver's entry with and without the training-data subpackage and what it needs."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LOOK = """
import sys
for name in {hidden}:
    sys.modules[name] = None  # importing it raises ImportError, as where it is missing
import __spark_entry__ as entry
names, sql = set(entry.queries()), set(entry.oracle_sql())
assert sql <= names and len(names) >= 80, len(names)
assert not [n for n in names if n == "pipeline" or (n.startswith("op") and n[2].isdigit())], names
assert "genre_rank" in names
"""


@pytest.mark.parametrize("hidden", [["chartwise.llm", "corpus_pipeline"], ["chartwise.llm"], ["public_tokenizers"], ["zstandard", "public_tokenizers"]])
def test_the_library_stands_alone(hidden):
    done = subprocess.run([sys.executable, "-c", LOOK.format(hidden=hidden)], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
