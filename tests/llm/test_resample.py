"""Importance resampling against a plain version, and its parts on hard inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import resample
from corpusmill.llm.common import Scratch

SCHEMA = "doc_id long, text string, row string, rank string, n_words int, score double"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crcs(text):
    w = WORDS.findall((text or "").encode().lower())
    return [zlib.crc32(b" ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for text in [r[1] for r in rows]:
        s.update(c % 10_000 for c in crcs(text)[0])
    for text in target:
        t.update(c % 10_000 for c in crcs(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for r in rows:
        found, n = crcs(r[1])
        weight = sum(gain(c % 10_000) for c in found)
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for k, o in enumerate(able[: percent * len(able) // 100]):
        o[4] = k + 1
    return Counter(tuple(o[:5]) for o in out)


def made_rows():
    r = random.Random(3)
    vocabulary = [r.choice(["the", "of", "Ünter", "ñ", "日本", "x9", "Ab", "q" * 45, "w" * 300]) + str(k % 37) for k in range(200)]
    text = lambda n: " -".join(r.choice(vocabulary) for _ in range(n))
    rows = [(k, text(r.randrange(60)), "a", "b", 1, 1.0) for k in range(500)]
    rows += [(1000, None, "", "", 0, 0.0), (1001, "", "", "", 0, 0.0), (1002, "...", "", "", 0, 0.0), (1003, "z" * 100_000 + " a", "", "", 0, 0.0), (1004, text(9000), "", "", 0, 0.0)]
    return rows + [rows[7]] * 40 + [(None, text(30), "", "", 0, 0.0) for _ in range(3)], [text(30) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("percent", [5, 50, 100, 0])
def test_equals_brute_force(spark, percent):
    rows, target = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = Counter(tuple(x) for x in resample.importance(docs, items, percent).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert found == brute(rows, target, percent)


def test_checksums_of_all_features():
    texts = [r[1] for r in made_rows()[0][:30]] + ["z" * 70_000 + " b " + "y" * 41 + " " + "y" * 40, None, "one", "a b"]
    raw = [(t or "").encode() for t in texts]
    words, doc, crc = resample.features(raw)
    assert words.tolist() == [crcs(t)[1] for t in texts]
    assert Counter(zip(doc.tolist(), crc.tolist())) == Counter((k, c) for k, t in enumerate(texts) for c in crcs(t)[0])
    batched = [resample.features(b) for b in resample._batches(raw)]
    assert np.concatenate([b[0] for b in batched]).tolist() == words.tolist()


@pytest.mark.parametrize("values", [[5] * 1000, list(range(1000)), [1] * 500 + [2] * 500, [0] * 999 + [7], [k % 3 for k in range(1000)]])
@pytest.mark.parametrize("accuracy", [3, 10_000])
def test_brackets_hold_the_cutoff_whatever_the_sketch(spark, values, accuracy):
    rows = spark.createDataFrame([(v, None if k % 97 == 0 else k // 2, k) for k, v in enumerate(values)], "score long, doc_id long, row long").repartition(3)
    order = sorted(((-v, k % 97 == 0, 0 if k % 97 == 0 else k // 2, k) for k, v in enumerate(values)))
    for k in (1, 50, 999, 1000):
        low, high, above = resample.bracket(rows, k, 1000, accuracy)
        assert above == sum(v > high for v in values) < k <= sum(v >= low for v in values)
        with Scratch() as scratch:
            found = rows.where(resample.drawn(rows, k, 1000, scratch, accuracy)).collect()
            assert sorted(r.row for r in found) == sorted(o[3] for o in order[:k])
            placed = {r.row: r.place for r in resample.numbered(rows, "place", scratch).collect()}
        assert placed == {o[3]: n + 1 for n, o in enumerate(order)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert resample.importance(docs, items).collect() == []
    rows = made_rows()[0][:60]
    some = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(x) for x in resample.importance(some, items).collect()) == brute(rows, [])


def test_drawn_documents_keep_their_columns(spark):
    rows, target = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = resample.apply(docs, items, 10)
    assert out.columns == docs.columns
    expected = {x[0] for x in brute(rows, target, 10) if x[4]}
    assert {r.doc_id for r in out.select(F.col("doc_id")).collect()} == expected
