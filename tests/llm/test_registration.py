import re

import __spark_entry__ as entry
from corvane.llm import queries


def test_each_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries())
    assert numbers == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries()) <= set(entry.queries())
    assert "pipeline" in entry.queries()
