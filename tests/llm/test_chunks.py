"""Exact duplicates by chunk recipes against plain grouping."""

import hashlib
import random
from collections import Counter

import pytest

from corpusmill.llm import chunks

SCHEMA = "doc_id long, text string, keep_id string, row string, digest int"


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) of all rows, and how many stay for each."""
    size = Counter(r[1] or "" for r in rows)
    keep = {}
    for r in rows:
        t = r[1] or ""
        keep[t] = max(keep.get(t, -1), -1 if r[0] is None else r[0])
    keep = {t: None if k < 0 else k for t, k in keep.items()}
    return Counter((r[0], keep[r[1] or ""], size[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), keep


def made_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij é") for _ in range(9))
    long = " ".join(word() for _ in range(40_000))
    texts = [None, "", "x", "X", "x ", long, long, long[:-1], long + "y", "z" + long, "a" * 70_000, "a" * 70_000, "a" * 70_001]
    texts += [" ".join(word() for _ in range(r.randrange(300))) for _ in range(40)]
    rows = [(k, t, "clash", "clash", 1) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[20], None, None, None) for k in range(700)] + rows[3:9] + [(None, texts[21], "", "", 2), (None, None, "", "", 2), (None, "only", "", "", 2), (None, "only", "", "", 2)]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_grouping_also_when_keys_clash(spark, bits):
    rows = made_rows()
    found = chunks.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), bits).collect()
    expected, keep = brute(rows)
    assert Counter((f.doc_id, f.keep_id, f.group_size, f.text_sha256) for f in found) == expected
    kept = Counter(f.text_sha256 for f in found if f.kept)
    assert kept == Counter(hashlib.sha256(t.encode()).hexdigest() for t in keep)
    assert all(f.doc_id == f.keep_id for f in found if f.kept)


def test_kept_documents_keep_their_columns(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = chunks.apply(docs)
    assert out.columns == docs.columns
    _, keep = brute(rows)
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == Counter((k, t) for t, k in keep.items())


def test_empty_table(spark):
    assert chunks.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cuts_follow_the_content():
    r = random.Random(7)
    data = bytes(r.randrange(97, 123) for _ in range(200_000))
    ends = chunks.cuts(data)
    assert b"".join(chunks.parts(data)) == data
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert max(sizes) <= chunks.MOST and min(sizes[:-1]) >= chunks.LEAST and 500 < sum(sizes) / len(sizes) < 3000
    moved = chunks.parts(b"q" * 300 + data)
    assert len(set(moved) & set(chunks.parts(data))) > 0.95 * len(ends)
    assert chunks.cuts(b"") == [] and chunks.cuts(b"a") == [1]


def test_a_hot_group_is_split(spark):
    rows = [(k, "same text", "", "", 0) for k in range(3000)] + [(5000 + k, f"text {k}", "", "", 0) for k in range(50)]
    found = chunks.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(f.kept for f in found) == 51
    assert {f.keep_id for f in found if f.group_size == 3000} == {2999}
