"""Slices of equal intervals: copies of an interval change nothing."""

import pytest

from corpusmill.operators import slices
from corpusmill.plans import registry


def rows(found):
    return sorted(map(tuple, found.select("path", "first", "last").collect()))


def test_equal_intervals_are_one(spark):
    once = [("a", 100, 108), ("a", 176, 184), ("a", 185, 186), ("b", 1, 3), ("b", 2, 3)]
    made = lambda n: spark.createDataFrame([x for x in once for _ in range(n)], "path string, first long, last long")
    expected = [("a", 100, 108), ("a", 176, 186), ("b", 1, 3)]
    for n in (1, 2, 50):
        assert rows(slices.merged(made(n))) == expected
        assert rows(slices.capped(slices.merged(made(n)), 4)) == expected


def test_windows_of_hits_at_the_ends_of_a_file_are_one(spark):
    hits = spark.createDataFrame([("a", k) for k in (1, 2, 3)] + [("b", 1), ("b", 20)], "path string, line long")
    sizes = spark.createDataFrame([("a", 3), ("b", 40)], "path string, n long")
    assert rows(slices.for_hits(hits, sizes, context=3)) == [("a", 1, 3), ("b", 1, 4), ("b", 17, 23)]


def equal_to_sql(spark, duck, folder, name, of, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{of}.parquet")
    own = duck.cursor()
    own.execute(f"create or replace temp view {of} as select * from '{folder}/{of}.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(folder)).collect())))
    assert got == sorted(map(repr, own.execute(registry.SQL[name]).fetchall()))
    return got


@pytest.mark.parametrize("name", ["q_slice_merge", "q_slice_cap"])
def test_intervals_without_ends_or_starts(spark, duck, tmp_path, name):
    items = [(1, 4, 8.0), (1, 4, None), (1, 7, None), (1, 150, 4.0), (1, None, 4.0), (2, 9, None), (2, 9, 40.0), (2, 60, None), (2, 15, 4.0)]
    items += [(3, 10 * k + k * k, q) for k in range(9) for q in (None, 4.0, 12.0)] + [(3, None, None)]
    got = equal_to_sql(spark, duck, tmp_path, name, "lineitem", "l_orderkey long, l_partkey long, l_quantity double", items)
    assert "('1', 5, 8)" not in got and "('1', 5, None)" not in got and "('1', 5, 7)" in got


def test_windows_of_documents_that_share_a_path(spark, duck, tmp_path):
    long = "\n".join("a mention" if k in (2, 20, 33) else "x" for k in range(1, 41))
    docs = [(1, "a mention\nx\nx", "en", "s"), (1, long, "en", "s"), (2, "x\nmention", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s")]
    got = equal_to_sql(spark, duck, tmp_path, "q_term_slices", "documents", "doc_id long, text string, lang string, source string", docs)
    assert len(got) == 4
