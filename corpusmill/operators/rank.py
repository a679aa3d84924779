"""Ranking of files against a task: terms, weights, scores, graph and change signals."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import (
    LANGUAGES,
    STOP_WORDS,
    base_name,
    directory,
    extension,
    is_test_path,
    normal_path,
    occurrences,
    words_of_identifier,
)
from corpusmill.sources.shared import shared_folder, written

# Weights of a term by where it comes from, and of the other signals.
WEIGHTS = {"search": 6, "identifier": 10, "config": 8, "endpoint": 7, "path": 9}
PATH_WEIGHT, BREADTH_WEIGHT, ENTRYPOINT_WEIGHT, IMPORT_FACTOR = 14, 6, 40, 0.2
CHANGED, CHANGED_REVIEW, IMPORTER, TESTER = 180, 260, 90, 75

_ENDINGS = "|".join(LANGUAGES)
_KINDS = (
    ("endpoint", re.compile(r"/[A-Za-z0-9/_\-.:{}]+")),
    ("path", re.compile(rf"\.{{1,2}}/.+|[^/]+/.+|.+\.(?:{_ENDINGS})")),
)
_CONFIG = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Za-z]\w*(?:\.\w+)+")
_IDENTIFIER = re.compile(r"\w+[A-Z]\w*|[A-Za-z]\w*_\w+|[A-Za-z]\w*(?:\.\w+)+")


def task_terms(text: str) -> dict[str, list[str]]:
    """Terms of a task by category, each once, in order."""
    found: dict[str, dict[str, None]] = {k: {} for k in ("identifier", "path", "config", "endpoint", "search")}
    for token in re.findall(r"[A-Za-z0-9_./:\-]+", text):  # a fixed pattern
        token = token.rstrip(".,;:!?")
        if len(token) < 2:
            continue
        kind = next((k for k, p in _KINDS if p.fullmatch(token)), None)
        if kind:
            found[kind][token] = None
        else:
            if _CONFIG.fullmatch(token):
                found["config"][token] = None
            if _IDENTIFIER.fullmatch(token):
                found["identifier"][token] = None
        split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token)
        for word in re.split(r"[\s/._:\-]+", split.lower()):
            if len(word) > 1 and word not in STOP_WORDS:
                found["search"][word] = None
    return {k: list(v) for k, v in found.items()}


def term_weights(terms: dict[str, list[str]]) -> dict[str, int]:
    """Weight of each literal to count: raw tokens and their parts add up."""
    out: dict[str, int] = defaultdict(int)
    for kind, weight in WEIGHTS.items():
        for token in terms.get(kind, ()):
            if kind in ("search", "identifier", "config") and len(token) > 1:
                out[token.lower()] += weight
            for part in words_of_identifier(token):
                out[part] += weight
    return dict(sorted(out.items()))


def weights_of(tasks: DataFrame) -> DataFrame:
    """task_id, term and weight of every task (task_id, text)."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, t, w) for i, text in zip(frame["task_id"], frame["text"], strict=True) for t, w in term_weights(task_terms(text or "")).items()]
            yield pd.DataFrame(rows, columns=["task_id", "term", "weight"])

    return tasks.select(F.col("task_id").cast("long").alias("task_id"), "text").mapInPandas(f, "task_id long, term string, weight int")


def path_terms(terms: dict[str, list[str]]) -> list[str]:
    return sorted({part for path in terms.get("path", ()) for part in words_of_identifier(path)})


def base_scores(files: DataFrame, text: Column, terms: dict[str, list[str]], entry: Column | None = None, keep: tuple[str, ...] = (), unscored: bool = False) -> DataFrame:
    """path, raw, hits and matched of the files of any score (``unscored``: of all), with the
    columns to ``keep``. The terms of a task are few, so each is one expression over the lower-cased text: no join."""
    weights, of_path = term_weights(terms), path_terms(terms)
    every = [(t, w, "text") for t, w in weights.items()] + [(t, PATH_WEIGHT, "path") for t in of_path]
    zero = F.lit(0).cast("long")

    def counted(low: Column) -> Column:
        return F.array(*[occurrences(low[where], t) for t, _, where in every]).cast("array<bigint>")

    def scored(n: Column) -> Column:
        terms_sum = sum((n[k] * w for k, (_, w, _) in enumerate(every)), zero)
        hits = sum((n[k] for k in range(len(every))), zero)
        seen = F.array(*[F.when(n[k] > 0, t) for k, (t, _, _) in enumerate(every)]).cast("array<string>")
        return F.struct(terms_sum.alias("terms"), hits.alias("hits"), F.array_sort(F.array_distinct(F.array_compact(seen))).alias("matched"))

    def raised(x: Column) -> Column:
        breadth = F.when(F.size(x["matched"]) > 1, BREADTH_WEIGHT * F.size(x["matched"])).otherwise(0)
        raw = x["terms"] + breadth + F.when(is_entry, ENTRYPOINT_WEIGHT).otherwise(0)
        return F.struct(raw.cast("double").alias("raw"), x["hits"].alias("hits"), x["matched"].alias("matched"))

    is_entry = F.lit(False) if entry is None else entry
    # Each step is bound by a lambda, so that the text is lowered and searched once a term;
    # a filter on the score in the plan would repeat that work.
    lowered = F.array(F.struct(F.lower(text).alias("text"), F.lower("path").alias("path")))
    found = F.transform(F.transform(F.transform(lowered, counted), scored), raised)
    shown = found if unscored else F.filter(found, lambda x: x["raw"] > 0)
    return files.select("path", *keep, F.explode(shown).alias("x")).select("path", "x.raw", "x.hits", "x.matched", *keep)


def import_boost(scores: DataFrame, edges: DataFrame, distinct: bool = True) -> DataFrame:
    """path and boost: every file that a scored one imports gets a share of its score.
    ``distinct=False`` says that no edge comes twice."""
    clean = edges.where("src <> dst").select("src", "dst")
    clean = clean.distinct() if distinct else clean
    fan = clean.groupBy("src").agg(F.count("*").alias("k"))
    given = clean.join(fan, "src").join(scores.select(F.col("path").alias("src"), "raw"), "src")
    return given.groupBy("dst").agg(F.sum(F.col("raw") * IMPORT_FACTOR / F.col("k")).alias("boost")).withColumnRenamed("dst", "path")


#: Hops that a search of the import graph goes at most.
MOST_HOPS = 6


def import_hops(sources: DataFrame, edges: DataFrame, wanted: list[str] | None = None, most: int = MOST_HOPS) -> DataFrame:
    """path and hops: how many imports lead from the nearest of some files (path) to each that
    they reach, 0 for themselves. A search by levels from all of them at once: each level is what the last one imports
    and none before has reached, written down before the next. It ends where nothing new is reached or after ``most`` levels.

    With ``wanted``, a few paths, only these are told: whether the next level holds them is looked up among the
    edges that lead to them before it is worked out, so the last and largest levels need not be."""
    spark = edges.sparkSession
    top = shared_folder(spark, "hops")
    level = written(sources.select("path", F.lit(0).cast("long").alias("hops")).distinct(), f"{top}/0")
    seen, found = level, {}
    if wanted is not None:
        found = {r.path: 0 for r in level.where(F.col("path").isin(wanted)).collect()}
    for k in range(1, most + 1):
        from_last = level.select(F.col("path").alias("src"))
        if wanted is not None:
            missing = [p for p in wanted if p not in found]
            if missing:
                near = edges.where(F.col("dst").isin(missing)).join(from_last, "src", "left_semi").select("dst").distinct()
                found |= {r.dst: k for r in near.collect()}
            if all(p in found for p in wanted):
                break
        met = edges.join(from_last, "src", "left_semi").select(F.col("dst").alias("path")).distinct()
        level = written(met.join(seen, "path", "left_anti").withColumn("hops", F.lit(k).cast("long")), f"{top}/{k}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen if wanted is None else spark.createDataFrame(sorted(found.items()), "path string, hops long")


def change_bias(changed: DataFrame, edges: DataFrame, tested: DataFrame, sizes: DataFrame, review: bool = False) -> DataFrame:
    """path, boost, reasons and mode from changed files, files that import them, and tests
    (test_path, path) of them."""
    own = changed.join(sizes, "path").select(
        "path", F.lit(CHANGED_REVIEW if review else CHANGED).alias("boost"), F.lit("changed_file").alias("reason"), F.when(F.col("size") > 80_000, "slices").otherwise("full").alias("mode")
    )
    importing = edges.where("src <> dst").join(changed.select(F.col("path").alias("dst")), "dst").select(F.col("src").alias("path")).distinct()
    importing = importing.select("path", F.lit(IMPORTER).alias("boost"), F.lit("imports_changed_file").alias("reason"), F.lit(None).cast("string").alias("mode"))
    tests = tested.join(changed, "path").select(F.col("test_path").alias("path")).groupBy("path").agg((TESTER * F.count("*")).cast("int").alias("boost"))
    tests = tests.select("path", "boost", F.lit("tests_changed_module").alias("reason"), F.lit(None).cast("string").alias("mode"))
    every = own.unionByName(importing).unionByName(tests)
    return every.groupBy("path").agg(
        F.sum("boost").cast("long").alias("boost"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.max("mode").alias("mode")
    )


def finished(scores: DataFrame, *boosts: DataFrame, limit: int = 200) -> DataFrame:
    """path, raw and score (1 to 1000 of the best), best first."""
    total = scores.select("path", "raw")
    for boost in boosts:
        total = total.unionByName(boost.select("path", F.col("boost").cast("double").alias("raw")))
    total = total.groupBy("path").agg(F.round(F.sum("raw"), 6).alias("raw")).where("raw > 0")
    # The score follows raw, so the limited rows hold the best; the window runs over them alone.
    top = total.orderBy(F.desc("raw"), "path").limit(limit)
    best = F.max("raw").over(Window.partitionBy())
    score = F.greatest(F.lit(1), F.least(F.lit(1000), F.floor(F.col("raw") / best * 1000 + 0.5))).cast("long")
    return top.withColumn("score", score).orderBy(F.desc("score"), F.desc("raw"), "path")


# Confidence of each sign that a file is an entry point.
CONFIDENCE = {"framework": 80, "routes": 70, "python_entry": 90, "go_main": 95, "rust_main": 90, "config": 55, "test_config": 60, "bin": 65, "shebang": 100}


def entrypoints(files: DataFrame, limit: int = 64) -> DataFrame:
    """path, score, confidence (percent of the best) and signs."""
    p, name = F.col("path"), base_name(F.col("path"))
    signs = {
        "framework": name.rlike(r"^(main|index|app|server|cli)\.(ts|js|tsx|jsx)$"),
        "routes": p.rlike(r"(^|/)(routes|controllers|handlers|api)(/|\.)"),
        "python_entry": name.isin("main.py", "app.py", "__main__.py", "manage.py"),
        "go_main": name == "main.go",
        "rust_main": name.isin("main.rs", "lib.rs"),
        "config": name.rlike(r"^(config|settings)\.|^\.env\.example$"),
        "test_config": name.rlike(r"^(jest|vitest|pytest|conftest)\b"),
        "bin": p.rlike(r"(^|/)bin/"),
        "shebang": F.col("content").startswith("#!"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("sign"), F.when(c, CONFIDENCE[k]).otherwise(0).alias("n")) for k, c in signs.items()])
    found = files.select("path", F.filter(each, lambda x: x["n"] > 0).alias("x")).where("size(x) > 0")
    found = found.select(
        "path",
        F.aggregate("x", F.lit(0).cast("long"), lambda acc, s: acc + s["n"]).alias("score"),
        F.array_join(F.array_sort(F.transform("x", lambda s: s["sign"])), ",").alias("signs"),
        F.size("x").alias("k"),
    )
    best = found.agg(F.max("score")).first()[0] or 1
    top = found.orderBy(F.desc("score"), F.desc("k"), "path").limit(limit)
    return top.select("path", "score", F.floor(F.col("score") * 100 / best + 0.5).cast("long").alias("confidence"), "signs")


# Endings tried for a package's target without one.
TARGET_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs")
# Confidence of a package's own entry points.
PACKAGE = {"package_main": 120, "package_bin": 110, "package_exports": 95}


def _texts(value: object) -> list[str]:
    """The texts within a JSON value, at any depth."""
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [text for one in inner for text in _texts(one)]


def _targets(content: str | None) -> list[tuple[str, str]]:
    try:
        body = json.loads(content or "")
    except (ValueError, RecursionError):
        return []
    if not isinstance(body, dict):
        return []
    bins = body.get("bin")
    named = {
        "package_main": [body["main"]] if isinstance(body.get("main"), str) else [],
        "package_bin": [bins] if isinstance(bins, str) else [b for b in bins.values() if isinstance(b, str)] if isinstance(bins, dict) else [],
        "package_exports": _texts(body.get("exports")),
    }
    return [(sign, target) for sign, targets in named.items() for target in targets]


def package_targets(files: DataFrame) -> DataFrame:
    """package, sign and target of the targets that package.json files name: ``main``,
    ``bin`` (a text or the texts of an object) and ``exports`` (any text within). Broken
    files name none."""

    @F.pandas_udf("array<struct<sign:string,target:string>>")
    def read(contents: pd.Series) -> pd.Series:
        return pd.Series([[{"sign": s, "target": t} for s, t in _targets(c)] for c in contents])

    own = files.where(base_name(F.col("path")) == "package.json")
    return own.select(F.col("path").alias("package"), F.inline(read("content"))).distinct()


def package_entrypoints(files: DataFrame) -> DataFrame:
    """path, sign and confidence of the files that packages name: the first that exists of the
    target, and, if it has no ending, the target with each ending and as a folder's index."""
    folder = F.regexp_extract("package", r"^(.*/)?[^/]*$", 1)
    joined = F.concat(folder, F.regexp_replace(F.replace("target", F.lit("\\"), F.lit("/")), r"^(\./)+", ""))
    # Steps up are taken one by one; a path above the root is none of the files.
    path = joined
    for _ in range(4):
        path = F.regexp_replace(path, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    tails = [tail for ending in TARGET_ENDINGS for tail in (ending, f"/index{ending}")]
    longer = F.when(extension(F.col("base")) == "", F.array(*[F.concat("base", F.lit(t)) for t in tails])).otherwise(F.array().cast("array<string>"))
    wanted = package_targets(files).select("package", "sign", "target", F.regexp_replace(path, "/+$", "").alias("base")).where("base <> ''")
    tried = wanted.select("package", "sign", "target", F.posexplode(F.concat(F.array("base"), longer)).alias("pos", "path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("package", "sign", "target").agg(F.min_by("path", "pos").alias("path"))
    confidence = F.create_map(*[F.lit(x) for item in PACKAGE.items() for x in item])[F.col("sign")]
    return found.select("path", "sign", confidence.cast("long").alias("confidence")).distinct()


def evidence(*signs: DataFrame, limit: int = 64) -> DataFrame:
    """path, score, confidence (percent of the best) and signs from evidence rows (path, sign,
    confidence): the greatest of each sign counts."""
    every = signs[0]
    for more in signs[1:]:
        every = every.unionByName(more)
    best = every.groupBy("path", "sign").agg(F.max("confidence").alias("n"))
    per = best.groupBy("path").agg(F.sum("n").alias("score"), F.array_sort(F.collect_list("sign")).alias("signs"))
    top = per.orderBy(F.desc("score"), F.desc(F.size("signs")), "path").limit(limit)
    percent = F.floor(F.col("score") * 100 / F.max("score").over(Window.partitionBy()) + 0.5)  # over the limited rows
    return top.select("path", "score", percent.cast("long").alias("confidence"), F.array_join("signs", ",").alias("signs"))


def search_text(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """path and text: the path, names and signatures of its symbols, paths and names of its
    imports, a line each in lower case. symbols: path, name, signature, line; imports: path,
    target, names."""
    part = lambda df, rank, *values: df.select("path", F.struct(F.lit(rank).alias("rank"), *values).alias("x"))
    line = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("at")
    none = F.lit(0).cast("long").alias("at")
    rows = part(files, 0, none, F.col("path").alias("text"))
    rows = rows.unionByName(part(symbols, 1, line("line"), F.concat_ws("\n", "name", "signature").alias("text")))
    rows = rows.unionByName(part(imports, 2, none, F.concat_ws("\n", "target", F.array_join("names", "\n")).alias("text")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n")
    known = files.select("path").distinct()
    return rows.join(known, "path", "left_semi").groupBy("path").agg(F.lower(text).alias("text"))


def indexed_scores(files: DataFrame, symbols: DataFrame, imports: DataFrame, terms: dict[str, list[str]], entry: Column | None = None) -> DataFrame:
    """``base_scores`` over what the index knows of each file (``search_text``) instead of its content: path, symbols and imports;
    ``entry`` is a column of the path. No term holds a line's end, so terms are counted in each row where it is made, rows without any term
    go no further, and only counts are grouped: no text is put together. A row of symbols may hold several (``scopes.symbols``)."""
    weights, of_path = term_weights(terms), path_terms(terms)
    zero = F.lit(0).cast("long")
    names = [f"n{k}" for k in range(len(weights))]

    any_term = "|".join(map(re.escape, weights))

    def counted(df: DataFrame, *values: str | Column, own: bool = False) -> DataFrame:
        low = df.select("path", F.lower(F.concat_ws("\n", *values)).alias("low"))
        low = low if own else low.where(F.col("low").rlike(any_term) if weights else F.lit(False))
        each = [F.when(F.contains("low", F.lit(t)), occurrences(F.col("low"), t)).otherwise(zero).alias(n) for n, t in zip(names, weights, strict=True)]
        return low.select("path", F.lit(own).alias("own"), *each)

    # Every file has a row, so that what the index does not know stays out.
    rows = counted(files.where("path is not null"), "path", own=True)
    rows = rows.unionByName(counted(symbols, "name", "signature")).unionByName(counted(imports, "target", F.array_join("names", "\n")))
    sums = rows.groupBy("path").agg(F.max("own").alias("own"), *[F.sum(n).alias(n) for n in names]).where("own")
    in_path = {f"p{k}": t for k, t in enumerate(of_path)}
    sums = sums.withColumns({n: occurrences(F.lower("path"), t) for n, t in in_path.items()})
    every = [(n, t, w) for n, (t, w) in zip(names, weights.items(), strict=True)] + [(n, t, PATH_WEIGHT) for n, t in in_path.items()]
    seen = {t: reduce(Column.__or__, [F.col(n) > 0 for n, other, _ in every if other == t]) for t in sorted({t for _, t, _ in every})}
    k = sum((F.when(there, 1).otherwise(0) for there in seen.values()), F.lit(0))
    raw = sum((F.col(n) * w for n, _, w in every), zero) + F.when(k > 1, BREADTH_WEIGHT * k).otherwise(0) + F.when(F.lit(False) if entry is None else entry, ENTRYPOINT_WEIGHT).otherwise(0)
    hits = sum((F.col(n) for n, _, _ in every), zero)
    matched = F.array_compact(F.array(*[F.when(there, F.lit(t)) for t, there in seen.items()]).cast("array<string>"))
    return sums.select("path", raw.cast("double").alias("raw"), hits.alias("hits"), matched.alias("matched")).where("raw > 0")


def mentioned(files: DataFrame, task: str) -> DataFrame:
    """The paths that a task's text holds."""
    return files.select("path").distinct().where(F.contains(F.lit(task.lower().replace("\\", "/")), F.lower("path")))


# Endings of tests beside a changed file's own.
TEST_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs")

#: Pairs of a stem and a folder's name that are broadcast at most; parts of the tests that one such pair meets.
MOST_ASKED, TEST_PARTS = 100_000, 32


def changed_paths(raw: DataFrame) -> DataFrame:
    """Changed paths, normalised, each once."""
    return raw.select(normal_path(F.trim("path")).alias("path")).where("path <> ''").distinct()


def tests_of(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(test_path, path): the tests of changed files. Those at the places where tests of a
    file lie; for a changed file without any, all test paths that hold its stem and, if it
    lies in named folders, the name of one of these.

    A test path meets stems and names of folders by its substrings of their lengths, and changed files by both, so
    the fallback is equal joins that give little more than the pairs of the result. Their number grows as the product of
    changed files and tests that share stems: each stem and name is dealt to ``TEST_PARTS`` parts, and no pair is shuffled (few
    bytes meet there and many rows come of them, so the number of tasks is set)."""
    known = files.select("path").distinct()
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    own = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    more = F.filter(F.array(*map(F.lit, TEST_ENDINGS)), lambda e: e != F.col("own"))
    endings = F.when(F.col("own") == "", F.array(*map(F.lit, TEST_ENDINGS))).otherwise(F.concat(F.array("own"), more))
    rows = changed.select("path", stem.alias("stem"), own.alias("own")).withColumn("endings", endings)
    name, folder = base_name(F.col("stem")), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    inner = F.regexp_replace("stem", "^src/", "")
    starts = [F.concat(F.lit("test/"), inner), F.concat(F.lit("tests/"), inner), F.col("stem"), F.concat(folder, F.lit("__tests__/"), name)]
    made = F.transform("endings", lambda e: F.array(*[F.concat(a, F.lit(kind), e) for a in starts for kind in (".test", ".spec")]))
    placed = rows.select("path", F.explode(F.array_distinct(F.flatten(made))).alias("test_path"))
    direct = placed.join(known.withColumnRenamed("path", "test_path"), "test_path").select("test_path", "path").distinct()
    left = changed.join(direct.select("path").distinct(), "path", "left_anti")
    low = F.lower(base_name(F.regexp_replace("path", r"\.[^./]*$", "")))
    words = F.array_distinct(F.filter(F.split(F.lower(directory(F.col("path"))), "/"), lambda w: (F.length(w) > 1) & (w != "src")))
    left = left.select("path", low.alias("stem"), F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words).alias("words")).where("stem <> ''").distinct().persist()
    asked = left.select("stem", F.explode("words").alias("word")).distinct().persist()
    lengths = [r.n for r in asked.select(F.explode(F.array(F.length("stem"), F.length("word"))).alias("n")).distinct().collect()]  # no more than the longest name has characters
    few = F.broadcast if asked.count() <= MOST_ASKED else lambda df: df

    def parts(n: int) -> Column:
        """The substrings of this length of the lower-cased test path."""
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low") - (n - 1))), lambda i: F.substring("low", i, F.lit(n)))

    every = F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(parts, lengths))))
    tests = known.where(is_test_path(F.col("path"))).select(F.col("path").alias("test_path"), F.lower("path").alias("low"))
    tests = tests.repartition(8 * TEST_PARTS, "test_path").withColumn("stem", every).join(few(asked.select("stem").distinct()), "stem", "left_semi")
    tests = tests.withColumn("word", every).join(few(asked), ["stem", "word"], "left_semi")
    tests = tests.withColumn("part", F.pmod(F.xxhash64("test_path"), F.lit(TEST_PARTS)))
    each = left.select("path", "stem", F.posexplode("words").alias("nth", "word"), "words").select("path", "stem", "word", F.slice("words", F.lit(1), F.col("nth")).alias("before"))
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TEST_PARTS - 1).cast("long"))))
    # A pair that several names make is taken at the first of them.
    keys = ["stem", "word", "part"]
    met = tests.repartition(8 * TEST_PARTS, *keys).join(each.repartition(8 * TEST_PARTS, *keys), keys).where(~F.exists("before", lambda w: F.contains(F.col("low"), w)))
    return direct.unionByName(met.select("test_path", "path"))


def test_candidates(changed: DataFrame) -> DataFrame:
    """(test_path, path): where the tests of a changed file may be."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    stem, ending = F.regexp_extract("path", r"([^/]*?)(\.[^./]+)$", 1), F.regexp_extract("path", r"(\.[^./]+)$", 1)
    made = F.array(
        F.concat(folder, stem, F.lit("_test"), ending),
        F.concat(folder, stem, F.lit(".test"), ending),
        F.concat(folder, stem, F.lit(".spec"), ending),
        F.concat(folder, F.lit("test_"), stem, ending),
        F.concat(folder, F.lit("tests/"), stem, ending),
        F.concat(F.lit("tests/"), folder, stem, ending),
        F.concat(F.lit("test/"), folder, stem, F.lit(".test"), ending),
    )
    return changed.select(F.explode(made).alias("test_path"), "path").distinct()
