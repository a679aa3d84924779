"""The operators made of DataFrame operations: mixing, quality rules, URL filters, components."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, mixing, quality, registry, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", None, 3),
        (4, "x " * 30_000, "en", "a", 60_000),
        (5, "one two three", None, "b", 13),
        (5, "one two three", None, "b", 13),
        (None, "no id here", "en", "b", 10),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1))


def test_mix_equals_sql(spark, sf_dir, duck):
    found = registry.op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(mixing.MIX_SQL).fetchall())


def test_mix_bounds_and_edges(spark):
    rows = mixing.mix_report(edge_docs(spark)).collect()
    assert len(rows) == 7
    assert all(r.taken <= 2 * r.size for r in rows)
    taken = collections.Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - target) < 1 for (_, target), n in taken.items())
    assert mixing.mix_report(edge_docs(spark).limit(0)).count() == 0


def test_schedule_is_even(spark):
    quotas = spark.createDataFrame([(0, 600, 600), (1, 300, 900), (2, 100, 1000)], "source_no int, quota long, upto long")
    rows = mixing.schedule(quotas, 1010).collect()
    for source, share in ((0, 0.6), (1, 0.3), (2, 0.1)):
        for upto in (100, 300, 900):
            assert abs(sum(r.source_no == source and r.slot < upto for r in rows) - share * upto) < 4


def test_applied_mix_takes_what_the_report_says(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.n for r in mixing.sizes(out).groupBy("doc_id").agg(F.sum("size").alias("n")).collect() if r.n}
    assert got == {r.doc_id: r.taken for r in mixing.mix_report(docs).collect() if r.taken}


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark, sf_dir):
    r = random.Random(1)
    made = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "\n\n x\n x\n", "é# |<é>"]
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(made, 10_000)), "doc_id long, text string")
    )
    judged = quality.judge(docs, []).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for x in judged:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_statistics(texts[x.doc_id])
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
        assert x.kept == (not x.base_failed)


def test_learned_rules_on_held_out_labels(spark, sf_dir):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    half = labels.where("doc_id % 2 = 0")
    rules = quality.fit(docs, half)
    assert rules
    rows = quality.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    bad = [x for x in rows if x.quality == 0]
    good = [x for x in rows if x.quality == 1]
    assert sum(x.kept for x in good) >= 0.98 * len(good)
    assert sum(not x.kept for x in bad) >= 0.8 * len(bad)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) == []
    assert quality.judge(docs, []).count() == 7
    assert quality.apply(docs, []).columns == docs.columns
    assert quality.judge(docs.limit(0), []).count() == 0


RULES = urlfilter.RULES


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_equal_brute_force(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    more = spark.createDataFrame([(10_000, u, "") for u in ("http://NET/es/", "x", "ftp://a.example.com", "http://b.net/frx", "http://www.EXAMPLE.com/en/a?b", "http://.net/fr/")] + [(1, None, None)], "page_id long, url string, html string")
    rows = pages.unionByName(more)
    found = sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in urlfilter.judge(rows).collect())
    assert found == sorted((x.page_id, *brute_verdict(x.url)) for x in rows.collect())


def test_aliases_carry_blocks_and_allows_take_precedence(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.org/x", link("http://b.net/es/1")),
        (2, "http://c.org/y", "<META content='0; URL=//a.org/x' http-equiv=Refresh>"),
        (3, None, link("http://b.net/es/1")),
        (4, "http://d.org/", link("http://b.net/es/2") + link("http://shop.com/k")),
        (5, "http://e.com/z", link("http://b.net/es/1")),
        (6, "http://f.org/q/r", link("s")),
        (7, "http://f.org/q/s", link("https://b.net/fr/1")),
    ]
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {x.page_id: (x.verdict, x.via) for x in found.collect()} == {
        1: ("allow", "alias"),
        2: ("allow", "alias"),
        3: ("allow", "default"),
        4: ("allow", "alias"),
        5: ("allow", "rule"),
        6: ("block", "alias"),
        7: ("block", "alias"),
    }
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(200 + k, 201 + k) for k in range(30)] + [(500, 600 + k) for k in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((x, root(x)) for x in linked)
