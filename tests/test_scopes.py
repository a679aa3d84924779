"""Nested scopes by brackets, indentation and levels, and the innermost one of a line."""

import random

import pytest

from corpusmill.operators import scopes

SCRIPT = """export class Foo {
  // function no() {
  async bar(a: string) {
    if (a) { return "}"; }
    function inner() { return `{
}`; }
  }
  get size() { return 1; }
}
export const x = { a: 1 };
function tail(
  b,
) {
  let y = 2;
}
interface I { z: number }
type T = string;
/* class Gone {
*/ enum E { A,
B }
"""
PYTHON = """import os

class Foo(Base):
    def bar(
        self,
    ):
        def inner():
            pass

        return 1

    async def baz(self): return 2
x = 1
def run(): pass
"""
RUST = """pub struct S { a: i32 }
impl S {
    pub fn go<'a>(&'a self) -> &'a str { "{" }
}
pub(crate) fn free() {}
mod m {
    trait T { fn f(&self); }
}
"""


def rows(text, language):
    return [(s[0], s[1], s[3], s[4], s[5], s[6]) for s in scopes.scopes_of(text, language)]


def test_script():
    assert rows(SCRIPT, "typescript") == [
        ("class", "Foo", 1, 9, 0, None), ("method", "bar", 3, 7, 1, 1), ("function", "inner", 5, 6, 2, 3), ("method", "size", 8, 8, 1, 1), ("variable", "x", 10, 10, 0, None),
        ("function", "tail", 11, 15, 0, None), ("interface", "I", 16, 16, 0, None), ("type", "T", 17, 17, 0, None),
    ]


def test_python():
    assert rows(PYTHON, "python") == [("class", "Foo", 3, 12, 0, None), ("method", "bar", 4, 10, 1, 3), ("function", "inner", 7, 8, 2, 4), ("method", "baz", 12, 12, 1, 3), ("function", "run", 14, 14, 0, None)]


def test_rust():
    assert rows(RUST, "rust") == [
        ("type", "S", 1, 1, 0, None), ("class", "S", 2, 4, 0, None), ("method", "go", 3, 3, 1, 2), ("function", "free", 5, 5, 0, None), ("module", "m", 6, 8, 0, None), ("interface", "T", 7, 7, 1, 6),
    ]


def test_markdown():
    text = "intro\n# One\na\n## Two\n```\n# no\n```\n### Three\n## Four ##\n# Five\n"
    assert rows(text, "markdown") == [("section", "One", 2, 9, 0, None), ("section", "Two", 4, 8, 1, 2), ("section", "Three", 8, 8, 2, 4), ("section", "Four", 9, 9, 1, 2), ("section", "Five", 10, 10, 0, None)]


@pytest.mark.parametrize("language", ["typescript", "python", "rust", "go", "java", "markdown", "html", "text"])
def test_any_text_gives_nested_ranges(language):
    r = random.Random(4)
    words = ["class A {", "}", "def f():", "    ", "fn g() {", "func h() {", "{", "}}", "'", '"', "`", "/*", "*/", "//", "# x", "## y", "<h1>a", "<h3>b", "\n", "x(y) {", "const k = 1;", "\\"]
    for _ in range(300):
        text = "".join(r.choice(words) + r.choice(["", "\n", " "]) for _ in range(r.randrange(30)))
        found = scopes.scopes_of(text, language)
        n = len(text.split("<" if language == "html" else "\n"))
        for k, s in enumerate(found):
            assert 1 <= s[3] <= s[4] <= n
            assert (s[6] is None) == (s[5] == 0)
            for o in found[:k]:
                assert o[4] < s[3] or s[4] <= o[4], (text, o, s)


def test_innermost(spark):
    r = random.Random(9)
    rows, points, expected = [], [], set()
    for f in range(40):
        marks = sorted({r.randrange(1, 60) for _ in range(r.randrange(12))})
        found = sorted(scopes.by_levels([(m, r.randrange(1, 5), f"s{m}") for m in marks], 60), key=lambda s: s[3])
        rows += [(f"p{f}", *s) for s in found]
        for at in range(1, 62, 3):
            points += [(f"p{f}", at)] * 2
            inside = [s for s in found if s[3] <= at <= s[4]]
            best = max(inside, key=lambda s: s[5], default=[None] * 7)
            expected.add((f"p{f}", at, best[0], best[1], best[3], best[4], best[5]))
    got = scopes.innermost(spark.createDataFrame(points, "path string, at long"), spark.createDataFrame(rows, scopes.SCOPES)).collect()
    assert {tuple(x) for x in got} == expected and len(got) == len(expected)


def test_innermost_of_scopes_that_share_lines(spark):
    found = scopes.scopes(spark.createDataFrame([("a", "typescript", SCRIPT), ("n", None, None)], "path string, language string, content string"))
    points = spark.createDataFrame([("a", k) for k in range(1, 20)], "path string, at long")
    got = {r.at: r.name for r in scopes.innermost(points, found).collect()}
    assert [got[k] for k in (1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 15, 16, 18)] == ["Foo", "Foo", "bar", "inner", "inner", "bar", "size", "Foo", "x", "tail", "tail", "I", None]


def test_every_scope_of_a_file_counts(spark):
    n = scopes.GIVEN + 1500
    files = spark.createDataFrame([("a", "html", "<h1>top" + "".join(f"<h2>s{k}" for k in range(2, n + 1))), ("b", "python", "".join(f"def f{k}(): pass\n" for k in range(1, 1501)))], "path string, language string, content string")
    found = scopes.scopes(files)
    assert {(r.path, r.n) for r in found.groupBy("path").agg({"line": "count"}).toDF("path", "n").collect()} == {("a", n), ("b", 1500)}
    got = {(r.path, r.at): r.name for r in scopes.innermost(spark.createDataFrame([("a", n + 1), ("b", 1500)], "path string, at long"), found).collect()}
    assert got == {("a", n + 1): f"s{n}", ("b", 1500): "f1500"}
    assert {r.path: len(r.name.split("\n")) for r in scopes.symbols(files).collect()} == {"a": n, "b": 1500}


def test_sections_of_a_page_with_many_headings(spark, duck, tmp_path):
    from corpusmill.plans import registry

    html = "".join(f"<h{1 + k * k % 6}>s{k}</h{1 + k * k % 6}><p>mention {k}</p>" for k in range(1400))
    spark.createDataFrame([(1, html), (2, "<h1>one<p>section"), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    own = duck.cursor()
    own.execute(f"create temp view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("q_page_sections", "q_page_outline"):
        got = sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(repr, own.execute(registry.SQL[name]).fetchall()))
        assert len(got) == 1401
