"""The entry point stands without the corpus operators and without the libraries they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(k.startswith('op') for k in q), set(o) <= set(q))"


def counted(*hidden):
    code = "".join(f"sys.modules[{m!r}] = None; " for m in hidden)
    got = subprocess.run([sys.executable, "-c", f"import sys; {code}{COUNT}"], cwd=ROOT, capture_output=True, text=True, check=True)
    return got.stdout.split()


@pytest.mark.parametrize("hidden", ["zstandard", "regex", "public_tokenizers", "bourse.llm", "corpus_pipeline"])
def test_a_missing_library_costs_no_other_query(hidden):
    n, oracles, corpus, covered = counted(hidden)
    assert int(n) > 160 and int(oracles) > 150 and corpus == "False" and covered == "True"
