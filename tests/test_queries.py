"""Every query against its SQL twin on the smallest tables."""

import pytest

from fieldlead.plans import core_queries, problems

CASES = {name: (m.QUERIES[name], m.SQL[name]) for m in (problems, core_queries) for name in m.SQL}


@pytest.mark.parametrize("name", CASES)
def test_matches_sql(compare, name):
    left, right = compare(*CASES[name])
    assert left == right


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(CASES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
