"""Scan rules, roll-ups and tree listings over files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import PIPELINE_LANGUAGES, base_name, directory, extension, glob_regex, language, lines_of, matches_any, module, stable_hash, tokens


def classify(files: DataFrame, max_bytes: int, never=(), include=(), exclude=(), binary_endings=(), rules: DataFrame | None = None) -> DataFrame:
    """Adds reason: why a file is left out (ignored, never, binary, size, excluded), null if
    it stays. A file that an include glob names may be of any size; ``rules`` are those of
    ``ignore_rules`` and come first."""
    path = F.col("path")
    binary = extension(path).isin(list(binary_endings))
    if "binary" in files.columns:
        binary = binary | F.col("binary")
    large = (F.col("size") > int(max_bytes)) & ~matches_any(path, list(include))
    reason = F.when(matches_any(path, list(never)), "never").when(binary, "binary").when(large, "size")
    reason = reason.when(matches_any(path, list(exclude)), "excluded")
    if rules is None:
        return files.withColumn("reason", reason)
    known = ignored(files, rules, prune=True)
    return known.withColumn("reason", F.when(F.col("ignored"), "ignored").otherwise(reason)).drop("ignored")


# Folders and endings that a plain scan leaves out.
PLAIN_SKIPPED = (".git", "node_modules", "dist")
PLAIN_BINARY = ("png", "jpg", "jpeg", "gif", "webp", "pdf", "zip", "tar", "gz", "exe", "dll", "so", "dylib", "woff", "woff2")


def plain(files: DataFrame, max_bytes: int, skip_binary: bool = True, skipped: tuple[str, ...] = PLAIN_SKIPPED) -> tuple[DataFrame, DataFrame]:
    """A scan without ignore rules: the files (path, size, mtime and language) below no ``skipped``
    folder (a tool adds its own), and one row of counts: files, those left out by size, and those by their ending."""
    below = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: p.isin(*skipped))
    large = F.col("size") > max_bytes
    binary = extension(F.col("path")).isin(*PLAIN_BINARY) if skip_binary else F.lit(False)
    every = files.where(~below)
    kept = every.where(~large & ~binary).select("path", "size", "mtime", language(F.col("path"), PIPELINE_LANGUAGES).alias("language"))
    return kept, every.agg(F.count_if(~large & ~binary).alias("files"), F.count_if(large).alias("by_size"), F.count_if(~large & binary).alias("by_binary"))


def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """(regex, negated) of a line of an ignore file, for paths below its folder, where a
    folder's path ends in a slash; null for a comment or an empty line."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    body = rule[negated:].removeprefix("\\")
    folder, body = body.endswith("/"), body.rstrip("/")
    anchored = "/" in body
    inner = re.sub(r"(^|/)\[\^/\]\*$", r"\1[^/]+", glob_regex(body.removeprefix("/"))[1:-1])  # a star alone is some name
    return f"^{'' if anchored else '(?:.*/)?'}{inner}{'/.*' if folder else '(?:/.*)?'}$", negated


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """layer, ord, base, regex and negated of all ignore files among the files: one layer a
    folder, deeper ones later."""

    @F.pandas_udf("struct<regex:string,negated:boolean>")
    def compiled(rules: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ignore_regex(r or "") or (None, None) for r in rules], columns=["regex", "negated"])

    own = files.where(base_name(F.col("path")) == name)
    lines = own.select(directory(F.col("path")).alias("base"), F.posexplode(lines_of(F.col("content"))).alias("ord", "rule"))
    layer = F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", "/")))
    return lines.select(layer.alias("layer"), "ord", "base", compiled("rule").alias("x")).select("layer", "ord", "base", "x.*").where("regex is not null")


def ignored(files: DataFrame, rules: DataFrame, prune: bool = False) -> DataFrame:
    """Adds ignored by layered rules (layer, ord, base, regex, negated), which match a path
    or one of its directories below ``base``; the last rule that matches decides. With
    ``prune`` each folder above a file is judged too, and what lies in an ignored one is
    ignored whatever later rules say. Rules are joined by their base directory."""
    parts = F.split("path", "/")
    above = lambda path: F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda k: F.array_join(F.slice(path, 1, k), "/"))
    # Spark's slice counts from 1; the empty prefix is the root.
    probed = files.select("path", parts.alias("parts")).distinct().withColumn("probe", F.col("path"))
    if prune:
        folders = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.lit("/")))
        folders = F.when(F.size("parts") > 1, folders).otherwise(F.array().cast("array<string>"))
        probed = probed.withColumn("probe", F.explode(F.concat(folders, F.array("path"))))
    probed = probed.withColumn("parts", F.split(F.regexp_replace("probe", "/$", ""), "/"))
    spread = probed.select("path", "probe", F.explode(above(F.col("parts"))).alias("base"))
    rest = F.when(F.col("base") == "", F.col("probe")).otherwise(F.expr("substring(probe, length(base) + 2)"))
    hit = spread.withColumn("rest", rest).join(rules, "base").where(F.expr("rest rlike regex"))
    last = hit.groupBy("path", "probe").agg(F.max_by("negated", F.struct("layer", "ord")).alias("negated"))
    last = last.groupBy("path").agg(F.bool_or(~F.col("negated")).alias("ignored"))
    return files.join(last, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def language_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def token_totals(files: DataFrame, by: str) -> DataFrame:
    return files.groupBy(by).agg(F.sum(tokens(F.col("content"))).alias("tokens"), F.count("*").alias("files"))


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files under every directory, at any depth."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    spread = files.select(F.explode(F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))).alias("dir"))
    return spread.groupBy("dir").agg(F.count("*").alias("files"))


def tree_lines(files: DataFrame, most_lines: int = 500, most_depth: int | None = None) -> DataFrame:
    """ord, depth and text of the listing: directories before files, by name. A listing that
    is too long ends in a line that tells how many more there are."""
    parts = F.split("path", "/")
    dirs = directory_rollup(files).select(
        F.concat_ws("/", F.transform(F.split("dir", "/"), lambda x: F.concat(F.lit("0"), x))).alias("key"),
        (F.size(F.split("dir", "/")) - 1).cast("long").alias("depth"),
        F.concat(F.element_at(F.split("dir", "/"), -1), F.lit("/ ["), "files", F.lit(" files]")).alias("text"),
    )
    names = F.concat_ws(
        "/",
        F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(F.lit("0"), x)),
        F.array(F.concat(F.lit("1"), F.element_at(parts, -1))),
    )
    leaves = files.select(names.alias("key"), (F.size(parts) - 1).cast("long").alias("depth"), F.element_at(parts, -1).alias("text"))
    every = dirs.unionByName(leaves)
    if most_depth is not None:
        every = every.where(F.col("depth") <= most_depth)
    return _listed(every, most_lines)


def _listed(every: DataFrame, most_lines: int) -> DataFrame:
    """ord, depth and text of the first lines by key, the last a marker if some are left out."""
    kept = every.orderBy("key").limit(most_lines)  # the window runs over these lines alone
    numbered = kept.select(F.row_number().over(Window.orderBy("key")).cast("long").alias("ord"), "depth", "text")
    n = every.count()
    if n <= most_lines:
        return numbered
    last, marker = F.col("ord") == most_lines, F.lit(f"... {n - most_lines + 1} more")
    return numbered.select("ord", F.when(last, F.lit(0).cast("long")).otherwise(F.col("depth")).alias("depth"), F.when(last, marker).otherwise(F.col("text")).alias("text"))


def capped_tree(files: DataFrame, per_level: int = 200, most_depth: int = 6) -> DataFrame:
    """path, folder (whether it is one) and depth of the entries that stay when each folder
    keeps its first entries by name and folders below ``most_depth`` are cut, with omitted: entries left
    out below each one that stays (for the root, path empty, also those left out of it)."""
    parts = F.split("path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k < F.size(parts)).alias("folder"), k.alias("depth")))
    entries = files.select(F.inline(every)).distinct().withColumn("parent", directory(F.col("path")))
    nth = F.row_number().over(Window.partitionBy("parent").orderBy("path", "folder"))
    marked = entries.withColumn("over", nth > per_level)
    # An entry goes with the first of its ancestors that goes.
    gone = marked.where("over").select(F.col("path").alias("above"), F.lit(True).alias("gone"))
    names = F.split("path", "/")
    own = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/"))
    lost = marked.select("path", "folder", F.explode(own).alias("above")).join(gone, "above").select("path", "folder").distinct().withColumn("lost", F.lit(True))
    judged = marked.join(lost, ["path", "folder"], "left").withColumn("stays", F.col("lost").isNull() & (F.col("depth") <= most_depth))
    # What is left out counts for its nearest ancestor that stays.
    stays = judged.where("stays").select("path", "folder", F.col("depth").cast("long").alias("depth"))
    out = judged.where("not stays").select("path", "folder", F.explode(F.concat(F.array(F.lit("")), own)).alias("above"))
    root = stays.sparkSession.createDataFrame([("", True, 0)], "path string, folder boolean, depth long")
    holders = stays.where("folder").unionByName(root)
    nearest = out.join(holders.select(F.col("path").alias("above"), "depth"), "above").groupBy("path", "folder").agg(F.max_by("above", "depth").alias("above"))
    counts = nearest.groupBy("above").agg(F.count("*").alias("omitted")).withColumnRenamed("above", "path")
    told = stays.unionByName(root).join(counts, "path", "left").withColumn("omitted", F.coalesce("omitted", F.lit(0)))
    return told.where("path <> '' or omitted > 0")


def listing(paths: DataFrame, limit: int = 400) -> DataFrame:
    """ord and text of the first paths, and how many more there are."""
    found = _listed(paths.select(F.col("path").alias("key"), F.lit(0).cast("long").alias("depth"), F.col("path").alias("text")), limit + 1)
    return found.select("ord", "text")


def module_map(files: DataFrame, most_modules: int = 30, most_languages: int = 3) -> DataFrame:
    """module, files, lines and its first languages, for the modules of most files."""
    rows = files.select(module(F.col("path")).alias("module"), "language", F.size(lines_of(F.col("content"))).cast("long").alias("lines"))
    per = rows.groupBy("module", "language").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    listed = F.transform(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "language", "n"))), 1, most_languages),
        lambda x: F.concat(x["language"], F.lit(":"), x["n"]),
    )
    whole = per.groupBy("module").agg(F.sum("n").alias("files"), F.sum("lines").alias("lines"), F.array_join(listed, ",").alias("languages"))
    return whole.orderBy(F.desc("files"), "module").limit(most_modules)


# Order of the kinds of symbols in a module's summary.
KINDS = ("class", "function", "interface", "type", "enum", "module", "variable", "method", "unknown")


def module_symbols(marks: DataFrame, per_module: int = 5) -> DataFrame:
    """module, nth, kind, path, line and signature of each module's first symbols: exported
    ones and modules first, then by kind, path, line and signature; equal ones count once.
    ``marks``: path, kind, line, signature."""
    shown = F.col("signature").startswith("export ") | (F.col("kind") == "module")
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    order = Window.partitionBy("module").orderBy(F.desc("shown"), F.when(kind == 0, len(KINDS)).otherwise(kind), "path", "line", "signature")
    rows = marks.select(module(F.col("path")).alias("module"), "kind", "path", "line", "signature").distinct().withColumn("shown", shown)
    ranked = rows.withColumn("nth", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("nth") <= per_module).select("module", "nth", "kind", "path", "line", "signature")


def omitted_modules(files: DataFrame, most_modules: int = 30) -> DataFrame:
    """One row: modules, and how many the map leaves out."""
    n = files.agg(F.countDistinct(module(F.col("path"))).alias("modules"))
    return n.select("modules", F.greatest(F.lit(0), F.col("modules") - most_modules).cast("long").alias("omitted"))


def repository(files: DataFrame, indexed: DataFrame, excluded: DataFrame, hints: DataFrame) -> DataFrame:
    """One row on a repository: files, bytes, languages, the state of its index (missing,
    stale or fresh), files left out by reason, and hints."""
    lang = F.array_sort(F.collect_set("language"))
    one = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.array_join(lang, ",").alias("languages"))
    both = files.select("path", "hash").join(indexed.select("path", F.col("hash").alias("old")), "path", "full_outer")
    state = both.agg(F.count("old").alias("known"), F.count_if(~F.col("hash").eqNullSafe(F.col("old"))).alias("differ"))
    state = state.select(F.when(F.col("known") == 0, "missing").when(F.col("differ") > 0, "stale").otherwise("fresh").alias("index"))
    listed = lambda df, key, n: df.agg(F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(":"), n))), ",").alias(f"{key}s"))
    reasons = listed(excluded.groupBy("reason").agg(F.count("*").alias("n")), "reason", "n")
    # Each side is a single row.
    key = F.lit(1).alias("one")
    parts = [d.select("*", key) for d in (one, state, reasons, listed(hints, "hint", "dirs"))]
    return parts[0].join(parts[1], "one").join(parts[2], "one").join(parts[3], "one").drop("one")


def synthetic(spark: SparkSession, n: int, modules: int = 7, lines: int = 20) -> DataFrame:
    """A made-up repository of ``n`` files for measuring: the files' columns, by number alone."""
    endings = F.array(*[F.lit(e) for e in ("ts", "py", "go", "rs", "js", "md", "json")])
    ending = F.get(endings, (F.col("id") % 7).cast("int"))
    group, layer = (F.col("id") % modules).cast("string"), (F.floor(F.col("id") / modules) % 5).cast("string")
    path = F.concat(F.lit("group"), group, F.lit("/layer"), layer, F.lit("/file"), F.col("id").cast("string"), F.lit("."), ending)
    line = lambda k: F.concat(F.lit("export function handler"), F.col("id").cast("string"), F.lit("_"), k.cast("string"), F.lit("() {}"))
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), line), "\n")
    made = spark.range(n).select(path.alias("path"), content.alias("content"), F.col("id").cast("double").alias("mtime"))
    size, digest = F.octet_length("content").cast("long"), stable_hash(F.col("content"))
    return made.select("path", size.alias("size"), "mtime", digest.alias("hash"), language(F.col("path")).alias("language"), "content")


def build_hints(files: DataFrame) -> DataFrame:
    """Directories of files that tell how a repository is built or run."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    hint = (
        F.when(name.isin("package.json", "index.js", "index.ts"), "node")
        .when(name.isin("pyproject.toml", "setup.py", "main.py"), "python")
        .when(name.isin("go.mod", "main.go"), "go")
        .when(name.isin("Cargo.toml", "main.rs"), "rust")
        .when(name.isin("Makefile"), "make")
    )
    found = files.select(hint.alias("hint"), directory(F.col("path")).alias("dir")).where("hint is not null")
    return found.groupBy("hint").agg(F.countDistinct("dir").alias("dirs"))
