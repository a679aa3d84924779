"""Ranking over the index: terms are counted row by row, and only counts are grouped."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import rank, scopes
from corpusmill.plans.registry import signals

TASK = "Rework OrderLine in src/api/order.ts, then /api/line and ORDER_MAX of the export class"
CODE = "path string, language string, content string"


def parts(spark):
    r = random.Random(3)
    words = ["Order", "line", "OrderLine", "export class", "api", "ÄRGER", "order_max", "ts", "then", "src/api/", "x", "İ", "Σ", None, ""]
    word = lambda: r.choice(words)
    paths = [f"{r.choice(['src/api', 'lib'])}/{r.choice(['Order', 'x', 'line'])}{k}.ts" for k in range(30)]
    files = [(p,) for p in paths] + [(paths[0],), (None,)]
    some = [*paths, "src/api/unknown.ts", None]
    symbols = [(r.choice(some), word(), word(), k) for k in range(300)]
    imports = [(r.choice(some), word(), r.choice([None, [], [word(), word()]])) for _ in range(200)]
    return (
        spark.createDataFrame(files, "path string"),
        spark.createDataFrame(symbols, "path string, name string, signature string, line long"),
        spark.createDataFrame(imports, "path string, target string, names array<string>"),
    )


def test_scores_are_those_of_the_whole_text_without_making_it(spark):
    files, symbols, imports = parts(spark)
    entry = F.col("path").rlike("x[0-9]")
    for task in (TASK, "the", "a/b.ts"):
        terms = rank.task_terms(task)
        for sign in (None, entry):
            found = rank.indexed_scores(files, symbols, imports, terms, sign)
            expected = rank.base_scores(rank.search_text(files, symbols, imports), F.col("text"), terms, sign)
            assert found.schema.names == expected.schema.names
            assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    plan = rank.indexed_scores(files, symbols, imports, rank.task_terms(TASK))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan


def test_symbols_are_the_words_of_scopes(spark):
    code = [
        ("a", "typescript", "export class A {\n  f(x) {\n    return 1;\n  }\n}\n"),
        ("b", "python", "class B:\n    def g(self):\n        pass\n"),
        ("c", "markdown", "# C\n## d\n"),
        ("e", "text", "class E"),
        ("n", None, None),
    ]
    files = spark.createDataFrame(code, CODE)
    each = {}
    for s in scopes.scopes(files).collect():
        each.setdefault(s.path, []).append((s.name, s.signature))
    expected = {(p, "\n".join(n for n, _ in own), "\n".join(s for _, s in own)) for p, own in each.items()}
    assert {tuple(x) for x in scopes.symbols(files).collect()} == expected and len(expected) == 3
    assert {tuple(x) for x in scopes.symbols(files, 1).select("path", "name").collect()} == {("a", "A"), ("b", "B"), ("c", "C")}


def test_code_has_the_set_number_of_tasks(spark, sf_dir):
    plan = signals.code_of_orders(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # not merged by bytes


def test_strings_and_comments_hide_what_they_hold():
    found = lambda text, language: [(s[1], s[3], s[4]) for s in scopes.scopes_of(text, language)]
    text = "class A { /*/ } { */\n  f(x) { return '\\'}' + \"\\\\\"; } // }\n  /* g() {\n } */ h() { return `}\n\\`}`; }\n}\nclass B {}\n"
    assert found(text, "typescript") == [("A", 1, 6), ("f", 2, 2), ("B", 7, 7)]
    assert found("class A:\n\tdef f(self):\n\t    x = 1\n    \tdef g(): pass\n", "python") == [("A", 1, 4), ("f", 2, 4), ("g", 4, 4)]
