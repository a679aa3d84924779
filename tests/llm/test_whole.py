"""Inputs beyond the lengths and shapes of the given tables."""

import collections
import hashlib
import random
import string
import time
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat, common, ctph, html, minhash, mixing, pii, quality, registry, urlfilter, warc


def test_secrets_of_any_length_are_redacted_whole():
    r = random.Random(11)
    made = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    jwt = f"eyJ{made(5000)}.{made(5000)}.{made(5000)}"
    texts = [
        f"x token={made(300)} y",
        f"x password   =    {made(300)} y",
        f"x {jwt} y",
        f"mail {'a' * 100} (at) b (dot) com",
        "mail x.y (at) " + " (dot) ".join(["sub"] * 8) + " (dot) com",
        "x(at)y.com_z(at)w.com",
    ]
    found = pii.find(texts, pii.fit_model())
    assert [pii.redacted(t, every) for t, (_, every) in zip(texts, found, strict=True)] == [
        "x token=[SECRET] y",
        "x password   =    [SECRET] y",
        "x [SECRET] y",
        "mail [EMAIL_SPELLED]",
        "mail [EMAIL_SPELLED]",
        "[EMAIL_SPELLED][EMAIL_SPELLED]",
    ]


@pytest.mark.parametrize(
    "part",
    ["<script>var x = 1</script>", "<style>p { x: y }</style>", "<label>x</label>", "<button>x<br>y</button>", "<select><option>x</select>", "<textarea>x</textarea>"]
    + ["<svg><title>x</title></svg>", "<svg/>", "<noscript>x</noscript>", "<title>x</title>", "<span class=ad>x</span>", "<span hidden>x</span>", "<b aria-hidden=true>x</b>"],
)
@pytest.mark.parametrize("outer", ["article", "div"])
def test_inline_parts_are_dropped(part, outer):
    a, b, c = (f"Enough words of part {k} to be found as the content of a page." for k in "abc")
    page = f"<html><head><title>T</title><style>s</style></head><body><{outer}><p>{a}</p>{part}<p>{b} {part}{c}</p></{outer}></body></html>"
    assert html.extract(page) == f"{a}\n\n{b} {c}"


def test_text_before_a_dropped_element_stays():
    a, b = (f"Enough words of part {k} to be found as the content of a page." for k in "ab")
    assert html.extract(f"<div>{a}<span class=ad><div>x</div></span></div><p>{b}<button>x</p>") == f"{a}\n\n{b}"


def test_a_closing_section_stays_on_a_long_page():
    body = "".join(f"<p>Paragraph {k} has enough words to be found as the content of a page.</p>" for k in range(200))
    menu = "<div>" + "<a href=x>go</a><br>" * 30 + "</div>"
    last = "The closing section is short, and still content of the page."
    for n in (1, 200):
        page = f"<body><div>{'</p>'.join(body.split('</p>')[:n])}</div>{menu * 12}<div><p>{last}</p></div>"
        assert html.extract(page).endswith(last)


def test_unmarked_text_stays_beside_marked_teasers():
    text = [f"Paragraph {k} of the page's own text, with enough words to be its content." for k in range(12)]
    teasers = "".join(f"<article><h2>Teaser {k}</h2><p>A short teaser.</p></article>" for k in range(3))
    page = f"<body><div>{''.join(f'<p>{x}</p>' for x in text)}</div><div>{teasers}</div>"
    found = html.extract(page).split("\n\n")
    assert found[:12] == text
    assert html.extract(f"<body><div><p>Outside.</p></div><article>{''.join(f'<p>{x}</p>' for x in text)}</article>").split("\n\n") == text


def test_long_tags_give_edges(spark):
    filler = "x" * 3000
    rows = [
        (1, "http://a.org/x", f'<link data-x="{filler}" rel="canonical" href="http://b.net/es/1">'),
        (2, "http://c.org/y", f"<meta http-equiv=refresh content='0; url=http://b.net/es/2?{filler}'>"),
        (3, "http://d.org/z", '<link rel="canonical" href="http://b.net/es/3"'),
        (4, "http://e.org/z", "<link canonical " * 60_000),
    ]
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {x.page_id: (x.verdict, x.via) for x in found.collect()} == {
        1: ("block", "alias"),
        2: ("block", "alias"),
        3: ("allow", "default"),
        4: ("allow", "default"),
    }


def test_applied_mix_comes_in_the_order_of_the_schedule(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "PART_SLOTS", 16)
    docs = common.table(spark, sf_dir, "documents")
    sized = common.Written(mixing.sizes(docs), "sizes").df
    aims = common.Written(mixing.targets(sized), "targets").df
    first = mixing.mix(sized, aims).groupBy("source_no", "epoch", "row_no", "doc_id").agg(F.min("slot").alias("slot")).collect()
    first.sort(key=lambda r: (r.slot is None, r.slot or 0, r.source_no, r.epoch, r.row_no))
    out = mixing.apply(docs)
    out.write.parquet(path := common.new_path(spark, "mixed"))
    assert [r.doc_id for r in out.collect()] == [r.doc_id for r in first]
    ordered = spark.read.parquet(path).select("doc_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")).collect()
    assert len({r.file for r in ordered}) > 1
    assert [r.doc_id for r in sorted(ordered, key=lambda r: (r.file, r.n))] == [r.doc_id for r in first]


LONG = "Enough words to be found as the content of a page by its ratio of text to tags."


@pytest.mark.parametrize("part", ['<h2 id="related-work">x</h2>', '<section id="social-impact"><p>x</p></section>', '<div class="notice-period">x</div>', '<div class="article-body">x</div>', '<div class="banner">x</div>', "<math>x</math>"])
def test_names_that_only_contain_a_part_stay(part):
    assert html.extract(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>") == f"{LONG}\n\nx\n\n{LONG}"


@pytest.mark.parametrize("name", ["cookie-notice", "comment-list", "post_comments", "siteNav", "ad-slot", "sidebar-left", "site-footer", "cookie-banner", "disqus_thread", "newsletter-signup"])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_named_parts_go(name, outer):
    assert html.extract(f"<{outer}><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG}</p></{outer}>") == f"{LONG}\n\n{LONG}"


def test_clusters_decide_within_an_article(monkeypatch):
    links = "".join(f"<li><a href=/{k}>Another story of the day {k}</a></li>" for k in range(8))
    items = "".join(f"<li>item {k}" for k in range(8))
    page = f"<article><h1><a href=/>Title</a></h1><p>{LONG}</p><p>{LONG}</p><ul>{items}</ul><p>{LONG}</p><div><p>Short.</p></div><ul>{links}</ul></article>"
    kept = ["Title", LONG, LONG, *[f"item {k}" for k in range(8)], LONG, "Short."]
    assert html.extract(page).split("\n\n") == kept
    monkeypatch.setattr(html, "regions", lambda ratios, links, least=0: html.np.ones(len(ratios), bool))
    assert len(html.extract(page).split("\n\n")) == len(kept) + 8
    monkeypatch.setattr(html, "regions", lambda ratios, links, least=0: html.np.zeros(len(ratios), bool))
    assert html.extract(page) == ""


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "x</p>" * 20_000, "<i><div>" + "<b>" * 20_000 + "x</i>" * 20_000, "<nav>" + "<div>x" * 20_000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    html.extract(page)
    assert time.process_time() - start < 3


def test_long_numbers_and_many_spans():
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(0, 5007, "ip")]
    assert pii.base_spans("1.2.3." + "9" * 5000) == []
    start = time.process_time()
    assert pii.base_spans("9" * 1_000_000) == []
    text = "call +1 212 555 1234 or 212-555-9876, x (AT) y (dot) com " * 4000
    ((base, every),) = pii.find([text], pii.fit_model())
    assert len(base) == 4000 and len(every) == 12_000
    assert time.process_time() - start < 20


def test_best_spans_stand():
    scored = [(0.9, (0, 10, "ssn")), (0.95, (5, 15, "iban")), (0.9, (14, 20, "ssn")), (0.8, (30, 40, "secret")), (0.7, (40, 50, "secret"))]
    assert sorted(pii.free_of([(38, 41, "card"), (60, 70, "ip")], scored)) == [(5, 15, "iban")]
    assert sorted(pii.free_of([], scored)) == [(5, 15, "iban"), (30, 40, "secret"), (40, 50, "secret")]


def test_only_what_slots_reach_is_taken(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents")
    whole = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    every = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: every(*a).where("slot < 20"))
    some = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    assert 0 < sum(some.values()) <= 20 * mixing.BLOCK_WORDS
    assert all(some[d] <= n for d, n in whole.items())
    monkeypatch.setattr(mixing, "schedule", lambda *a: every(*a).limit(0))
    assert sum(r.taken for r in mixing.mix_report(docs).collect()) == 0


@pytest.mark.parametrize("sizes", [[1, 5000, 1], [1] * 50 + [3], [2047, 2048, 2049, 1, 100_000]])
def test_every_block_has_a_slot(spark, sizes):
    upto = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    quotas = spark.createDataFrame(list(zip(range(len(sizes)), sizes, upto)), "source_no int, quota long, upto long")
    rows = mixing.schedule(quotas, upto[-1] * 101 // 100 + 64, upto[-1] * 2 + 64).groupBy("source_no").count().collect()
    assert {r.source_no: r["count"] for r in rows} == dict(enumerate(sizes))


# --- chat


@pytest.mark.parametrize("hot_rows", [512, 3])
def test_reading_follows_the_attended_intervals(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rows = [(k, 0, "user", "shared first turn") for k in range(40)] + [(k, 1, "assistant", f"half {k % 2}") for k in range(40)]
    rows += [(k, 2, "user", f"own {k}") for k in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    walked = common.Written(chat.paths(turns), "paths").df
    tree = chat.prefix_tree(walked)
    assert sorted((r.conv_id, r.n_turns) for r in chat.read_back(walked, tree).collect()) == [(k, 3) for k in range(40)]
    for wrong in ("filter(attend, x -> x.a > 0)", "transform(attend, x -> struct(x.a + 1 as a, x.b as b))", "transform(attend, x -> struct(x.a as a, x.b - 1 as b))"):
        with pytest.raises(Exception, match="turn|turns"):
            chat.read_back(walked, tree.withColumn("attend", F.expr(wrong))).collect()


def test_tree_is_summed_in_even_ranges(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(k, 0, "user", "shared") for k in range(400)] + [(k, 1, "assistant", f"half {k % 2}") for k in range(400)] + [(k, 2, "user", f"own {k}") for k in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = chat.prefix_tree(common.Written(chat.paths(turns), "paths").df)
    spans = sorted((r.start, r.end) for r in nodes.select("start", "end").collect())
    assert len(spans) == 403 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    ranged = common.in_ranges(nodes.select("root", "start"), "range", "root", "start")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranged.df.groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2.5 * sum(sizes) / len(sizes)


# --- quality rules


def test_one_row_of_an_id_is_learned_from(spark):
    words = lambda k: " ".join(f"{'#' * (k % 2)}w{j}" for j in range(k, k + 40))
    rows = [(f"d{k}", words(k)) for k in range(60)] + [("d1", words(k)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", 1 - k % 2) for k in range(60)] + [("d3", 0)] * 50, "doc_id string, quality int")
    rules = quality.fit(docs, labels)
    assert rules and rules == quality.fit(docs.repartition(7), labels.repartition(3))


def test_an_imprecise_rule_is_set_aside():
    r = random.Random(3)
    rows = []
    for k in range(900):
        x = dict.fromkeys(quality.FEATURES, 0.0) | {"bad": int(k % 4 == 0), "mean_word": r.random()}
        if x["bad"] and k % 8:
            x["upper_share"] = 0.9
        elif x["bad"]:
            x["shouts_per_word"] = 1.0 + r.random()
        # A noisy feature that leads more bad rows than either, but not precisely.
        x["bars_per_word"] = float(r.random() < (0.95 if x["bad"] else 0.03))
        rows.append(x)
    found = {c.feature for rule in quality.learn(rows) for c in rule.conditions}
    assert {"upper_share", "shouts_per_word"} <= found


# --- URL filters


def test_repeated_rows_and_clashing_columns(spark):
    link = '<link rel="canonical" href="http://b.net/es/1">'
    rows = [(1, "http://a.org/x", link)] * 3 + [(2, "http://a.org/x#part", None), (3, "http://c.org/" + "p" * 50_000, link)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "path", "node", "rule", "own", "brought", "tail"):
        pages = pages.withColumn(name, F.lit("clash"))
    found = [(x.page_id, x.verdict, x.via) for x in urlfilter.judge(pages).collect()]
    assert sorted(found) == [(1, "block", "alias")] * 3 + [(2, "block", "alias"), (3, "block", "alias")]


def test_aliases_equal_sql(spark, tmp_path):
    import duckdb

    link = '<link data-x="{}" rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.org/x", link("q", "http://b.net/es/1")),
        (2, "http://c.org/y", "<META content='0; URL=//a.org/x' http-equiv=Refresh>"),
        (3, None, link("q", "http://b.net/es/1")),
        (4, "http://d.org/", link("q", "http://b.net/es/2") + link("q", "http://shop.com/k")),
        (5, "http://e.com/z", link("q", "http://b.net/es/1")),
        (6, "http://f.org/q/r", link("q", "s")),
        (7, "http://f.org/q/s", link("q" * 5000, "https://b.net/fr/1")),
        (8, "http://g.org/one?a=1", link("q", "/two")),
        (9, "http://g.org/two", link("q", "http://www.example.com/en/k")),
        (10, "http://plain.org/", "<p>no link"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cursor = con.execute(urlfilter.JUDGE_SQL)
    names = [d[0] for d in cursor.description]
    found = registry.op5_urlfilter(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in found.select(*names).collect()) == sorted(map(repr, cursor.fetchall()))
    assert sum(r.via == "alias" for r in found.collect()) >= 5


# --- WARC


def test_archives_of_an_empty_table_and_odd_urls(spark):
    schema = "page_id long, url string, html string"
    assert warc.archive_pages(spark.createDataFrame([], schema)).count() == 0
    urls = ["http://a.b/x y", "http://a.b/x%20y", "http://a.b/x_y", "http://a.b/x+y", "http://a.b/\t\u2028é\r\nX: y", ""]
    rows = [(k, u, f"page {k} " * 30) for k, u in enumerate(urls)]
    found = warc.archive_pages(spark.createDataFrame(rows, schema)).collect()
    assert {r.page_id: r.url for r in found} == dict(enumerate(urls))
    assert len({r.url_key for r in found}) == len(urls)


def test_reader_holds_a_piece_at_a_time(monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 1000)
    blocks = [bytes([k % 251]) * (k * 37 % 5000) for k in range(400)]
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    packer = zlib.compressobj(wbits=31)
    most, feed = 0, warc._Stream.more

    def watched(self):
        nonlocal most
        out = feed(self)
        most = max(most, len(self.held))
        return out

    monkeypatch.setattr(warc._Stream, "more", watched)
    assert [b for _, _, b in warc.records(packer.compress(raw) + packer.flush())] == blocks
    assert most < 10_000 < len(raw)


def test_a_run_out_of_order_is_an_error():
    with pytest.raises(ValueError, match="not sorted"):
        list(warc.Losers([[(1, "a"), (3, "b"), (2, "c")], [(2, "d")]]))


# --- near duplicates


def variants(seed, base, rate, n, first):
    r = random.Random(seed)
    return [(first + k, " ".join(w if r.random() > rate else f"v{r.randrange(99_999)}" for w in base)) for k in range(n)]


def brute_links(rows, n=2):
    sets = {}
    for doc, text in rows:
        w = text.split()
        sets[doc] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("rounds", [0, 6])
def test_older_versions_that_lead_every_key(spark, rounds, monkeypatch):
    # Older versions with smaller ids, near misses of the rest, lead the keys of a family.
    monkeypatch.setattr(minhash, "MOST_ROUNDS", rounds)
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    r = random.Random(5)
    base = [f"w{r.randrange(9999)}" for _ in range(160)]
    older = [w if r.random() > 0.055 else f"o{k}" for k, w in enumerate(base)]
    rows = variants(1, older, 0.012, 40, 0) + variants(2, base, 0.03, 90, 1000) + variants(3, base, 0.065, 60, 2000)
    rows += [(3000, " ".join(base[:120])), (3001, " ".join(base[20:])), (3002, " ".join(base + base[:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, 2, 0.8).collect()}
    assert found == brute_links(rows)
    assert len(set(found.values())) > 2


def test_few_pairs_are_compared(spark, monkeypatch):
    r = random.Random(7)
    base = [f"w{r.randrange(9999)}" for _ in range(150)]
    rows = variants(4, base, 0.06, 1500, 0)
    compared = collections.Counter()
    every = minhash.candidates

    def counted(held, similarity, scratch, hot):
        out = every(held, similarity, scratch, hot)
        compared["outside"] = held.where("not inner").count()
        compared["all"] = compared["outside"] * held.count()
        compared["pairs"] = out.count()
        return out

    monkeypatch.setattr(minhash, "candidates", counted)
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 0.8).count()
    assert 0 < compared["outside"] and compared["pairs"] < 0.1 * compared["all"]


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "x y z u v w"), (2, "x y z u v w"), (None, "a b c d e f g")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_scratch_tables_are_dropped(spark, tmp_path):
    import os

    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    rows = variants(6, [f"w{k}" for k in range(60)], 0.05, 60, 0)
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 0.8).count()
    after = set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) - before
    assert sorted({name.split("-")[0] for name in after}) == ["classes", "components", "signatures"]


# --- fingerprints


def test_signatures_are_bounded(spark):
    for data in (b"g" * 5000, b"g" * 3_000_000, bytes(range(256)) * 4000, b"ab" * 77):
        _, one, two = ctph.fingerprint(data).split(":")
        assert len(one) <= ctph.MOST_CHARS and len(two) <= ctph.MOST_CHARS
    start = time.process_time()
    assert ctph.likeness(ctph.fingerprint(b"g" * 2_000_000), ctph.fingerprint(b"g" * 1_999_999 + b"h")) <= 1
    assert time.process_time() - start < 5


def test_long_neighbours_and_many_rows_of_one_id(spark):
    rows = [(1, "a" * 400_000), (2, "b c " * 100_000), (3, None)] + [(7, f"text {k} " * 20) for k in range(600)]
    found = ctph.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), range_docs=50).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found if r.doc_id != 7}
    assert (by[1].n_chars, by[2].n_chars, by[3].n_chars) == (400_000, 400_000, 0)
    edited = "b c " * 50_000 + "a" * 200_000
    assert by[2].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sorted(r.n_chars for r in found if r.doc_id == 7) == sorted(len(f"text {k} " * 20) for k in range(600))
