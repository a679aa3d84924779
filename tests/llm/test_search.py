"""Ranked search against a plain version, and what its bounds skip."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import search

DOCS = "doc_id long, text string, rank int, score string, item_id long, n int, terms string"
ITEMS = "item_id long, text string, doc_id long, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    found = [(d[0], Counter(terms_of(d[1]))) for d in docs]
    n_docs, all_terms = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    wanted = {}
    for item in items:
        wanted.setdefault(item[0], set()).update(terms_of(item[1]))
    out = Counter()
    for item, terms in wanted.items():
        scored = []
        for doc, c in found:
            m = 100 - 50 + (50 * c.total() * n_docs) // max(all_terms, 1)
            s = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out.update((item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top]))
    return out


def made(n_docs=900, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünter", "ÜNTER", "ABC", "abc", "日本", "a1b2"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choices(vocabulary, weights, k=n))
    docs = [(k, text(r.randrange(80)), k, "x", k, 0, "t") for k in range(n_docs)]
    docs += [(5000, None, 0, "", 0, 0, ""), (5001, "", 0, "", 0, 0, ""), (5002, "!?", 0, "", 0, 0, ""), (5003, text(20_000), 0, "", 0, 0, "")]
    docs += [docs[5]] * 60 + [(None, text(30), 0, "", 0, 0, "") for _ in range(4)] + [(6000 + k, docs[7][1], 0, "", 0, 0, "") for k in range(200)]
    items = [(k, text(25), 0, "") for k in range(12)] + [(50, None, 0, ""), (51, "nowhere", 0, ""), (3, text(5), 0, ""), (None, text(4), 0, ""), (52, "日本 abc ünter", 0, ""), (53, docs[7][1], 0, "")]
    return docs, items


@pytest.mark.parametrize("pairs", [50_000, 40])
def test_equals_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(search, "MOST_PAIRS", pairs)
    docs, items = made()
    found = search.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute(docs, items)


@pytest.mark.parametrize("shape", [(64, 8), (300, 32)])
def test_bounds_skip_and_lose_nothing(shape, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", shape[1])
    r = np.random.default_rng(4)
    n_terms, n_docs = shape[0], 3000
    weights = np.sort(r.integers(0, 9000, n_terms))
    lengths = r.integers(1, 30, n_docs)
    terms = np.concatenate([r.choice(n_terms, n, replace=False, p=(q := 1 / (1 + np.arange(n_terms)[::-1])) / q.sum()) for n in lengths])
    values = r.integers(1, 1_000_000, len(terms))
    items = search.Items([0, 1], [np.array([0, 5, 9, n_terms - 1]), np.arange(0, n_terms, 3)], weights)
    shard = search.Shard(items, np.arange(n_docs), np.zeros(n_docs, bool), lengths, terms, values)
    scored = []
    plain = shard.scores
    monkeypatch.setattr(shard, "scores", lambda docs, w: scored.append(len(docs)) or plain(docs, w))
    for own in items.terms:
        best = search.Best(1)
        scored.clear()
        shard.search(own, best)
        w = np.zeros(n_terms, np.int64)
        w[own] = weights[own]
        every = plain(np.arange(n_docs), w)
        order = np.lexsort((np.arange(n_docs), -every))[: search.TOP]
        assert best.ids.tolist() == [k for k in order.tolist() if every[k] > 0]
        assert best.scores.tolist() == [every[k] for k in best.ids]
        assert sum(scored) < np.count_nonzero(every)
    for term, (cut, starts, columns, maxima) in shard.known.items():
        summary = np.zeros((len(cut), len(items.beside[term])), np.int64)
        for row, a, b in zip(summary, starts, [*starts[1:], len(columns)], strict=True):
            row[np.searchsorted(items.beside[term], columns[a:b])] = maxima[a:b]
        assert sorted(np.concatenate(cut).tolist()) == sorted(shard.postings[shard.upto[term] : shard.upto[term + 1]].tolist())
        for docs, row in zip(cut, summary, strict=True):
            assert len(docs) <= shape[1]
            for c, top in zip(items.beside[term].tolist(), row.tolist(), strict=True):
                own = [values[a] for d in docs for a in range(shard.starts[d], shard.starts[d] + lengths[d]) if terms[a] == c]
                assert top == max(own, default=0)


def test_empty_tables(spark):
    docs, items = made(20)
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert search.ranked(none, spark.createDataFrame(items, ITEMS)).collect() == []
    assert search.ranked(spark.createDataFrame(docs, DOCS), no_items).collect() == []
    blank = spark.createDataFrame([(1, None, 0, "", 0, 0, ""), (2, "", 0, "", 0, 0, "")], DOCS)
    assert search.ranked(blank, spark.createDataFrame(items, ITEMS)).collect() == []


def test_long_items_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 3000)
    r = random.Random(6)
    vocabulary = [f"v{k}" for k in range(20_000)]
    docs = [(k, " ".join(r.choices(vocabulary, k=r.choice([5, 50, 5000]))), 0, "", 0, 0, "") for k in range(120)]
    items = [(1, " ".join(vocabulary), 0, ""), (2, " ".join(vocabulary[:9000]), 0, ""), (3, "v1 v2 v3", 0, "")]
    found = search.ranked(spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(items, ITEMS))
    assert Counter(map(tuple, found.collect())) == brute(docs, items)


def test_shards_are_bounded(monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 10)
    monkeypatch.setattr(search, "SHARD_DOCS", 3)
    frame = search.pd.DataFrame({"terms": [[0] * n for n in (4, 4, 4, 1, 1, 1, 1, 30, 2)]})
    assert [[len(t) for t in part["terms"]] for part in search._shards(frame)] == [[4, 4], [4, 1, 1], [1, 1], [30], [2]]
