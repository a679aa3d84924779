"""Every registered query of the library against its SQL in DuckDB."""

import pytest

from corpusmill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(map(repr, map(tuple, found.select(*columns).collect())))
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert rows


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
