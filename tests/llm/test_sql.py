"""The operators' queries against their SQL in DuckDB."""

import pytest

from corpusmill.llm import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    found = registry.queries()[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    order = [names.index(c) for c in found.columns]
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())


def test_one_query_for_each_operator():
    names = list(registry.queries())
    assert all(sum(name.startswith(f"op{n}_") for name in names) == 1 for n in range(1, 14))
    assert "pipeline" in names
