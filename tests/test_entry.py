"""The core stays whole where the optional package cannot be imported."""

import subprocess
import sys

from corvane.plans.catalog import QUERIES

HIDE = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def test_core_without_a_library_of_the_optional_package():
    out = subprocess.run([sys.executable, "-c", HIDE], capture_output=True, text=True, check=True).stdout
    n_queries, n_oracles = map(int, out.split()[-2:])
    assert n_queries == len(QUERIES) and 0 < n_oracles <= n_queries
