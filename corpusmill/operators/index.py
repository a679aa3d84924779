"""The incrementally maintained index: plan, merge, imports and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import import_names, lines_of, symbol_name


def _delta(scan: DataFrame, state: DataFrame, *columns: str) -> DataFrame:
    """path, new, old (null where a side lacks the path) and action, by one full outer join."""
    new = scan.select("path", F.struct(*columns).alias("new"))
    both = new.join(state.select("path", F.struct(*columns).alias("old")), "path", "full_outer")
    action = (
        F.when(F.col("new").isNull(), "delete")
        .when(F.col("old").isNull(), "upsert")
        .when(F.col("new.mtime") == F.col("old.mtime"), "unchanged")
        .when((F.col("new.hash") != "") & (F.col("new.hash") == F.col("old.hash")), "touch")
        .otherwise("upsert")
    )
    return both.withColumn("action", action)


def plan(scan: DataFrame, state: DataFrame) -> DataFrame:
    """path and action: upsert, touch (only the time changed), unchanged or delete."""
    return _delta(scan, state, "mtime", "hash").select("path", "action")


def merged(scan: DataFrame, state: DataFrame) -> DataFrame:
    """The state after the plan: path, size, mtime, hash. Touched files keep size and hash."""
    both = _delta(scan, state, "size", "mtime", "hash").where("action <> 'delete'")
    keeps = F.col("action").isin("touch", "unchanged")
    return both.select(
        "path",
        F.when(keeps, F.col("old.size")).otherwise(F.col("new.size")).alias("size"),
        F.when(F.col("action") == "unchanged", F.col("old.mtime")).otherwise(F.col("new.mtime")).alias("mtime"),
        F.when(keeps, F.col("old.hash")).otherwise(F.col("new.hash")).alias("hash"),
    )


def replaced(rows: DataFrame, changed: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Per-file rows (symbols, imports) with those of changed files replaced."""
    return rows.join(changed.select("path"), "path", "left_anti").unionByName(new_rows)


def resolve_imports(raw: DataFrame, known: DataFrame, endings=(".ts", ".py", ".go", ".rs", ".js")) -> DataFrame:
    """Raw imports (src_path, base) to the first existing candidate: base, then base with an
    ending, then an index file; unresolved ones are dropped. Candidates are made once for each
    base, not for each import of it."""
    tails = ["", *endings, *[f"/index{e}" for e in endings]]
    bases = raw.select("base").distinct()
    spread = bases.select("base", F.posexplode(F.array(*[F.concat("base", F.lit(t)) for t in tails])).alias("pos", "path"))
    found = spread.join(known.select("path").distinct(), "path").groupBy("base").agg(F.min_by("path", "pos").alias("imported_path"))
    return raw.select("src_path", "base").distinct().join(found, "base").select("src_path", "base", "imported_path")


_JS = r"(?m)^\s*(?:import|export)\b[^'\"\n;]*?\bfrom\s*['\"]([^'\"\n]+)['\"]"
_REQUIRE = r"\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)"
_PY = r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import\b|import[ \t]+([\w.]+))"
_GO = r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"
_RUST = r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"


def raw_imports(files: DataFrame) -> DataFrame:
    """(src_path, target, reexport) as written, by the language's patterns."""
    c, lang = F.col("content"), F.col("language")
    script = lang.isin("typescript", "tsx", "javascript")
    every = lambda pattern, group=1: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    named = F.transform(every(_JS), lambda t: F.struct(t.alias("target"), F.lit(False).alias("reexport")))
    again = every(_JS.replace("(?:import|export)", "export"))
    named = F.transform(named, lambda x: F.struct(x["target"].alias("target"), F.array_contains(again, x["target"]).alias("reexport")))
    plain = lambda xs: F.transform(F.filter(xs, lambda t: t != ""), lambda t: F.struct(t.alias("target"), F.lit(False).alias("reexport")))
    none = F.array().cast("array<struct<target:string,reexport:boolean>>")
    found = (
        F.when(script, F.concat(named, plain(every(_REQUIRE))))
        .when(lang == "python", plain(F.concat(every(_PY, 1), every(_PY, 2))))
        .when(lang == "go", plain(every(_GO)))
        .when(lang == "rust", plain(every(_RUST)))
        .otherwise(none)
    )
    return files.select(F.col("path").alias("src_path"), F.explode(found).alias("x")).select("src_path", "x.target", "x.reexport").distinct()


def imported_names(files: DataFrame) -> DataFrame:
    """src_path, target, names and reexport of script imports: the names in braces without
    their ``as`` names, and the default one, sorted; ordered by source, target, names."""
    clause = r"(?m)^\s*(import|export)\s+(?:type\s+)?([^'\"\n;]*?)\s*\bfrom\s*['\"]([^'\"\n]+)['\"]"
    part = lambda k: F.regexp_extract_all("content", F.lit(clause), F.lit(k))
    scripts = files.where(F.col("language").isin("typescript", "tsx", "javascript"))
    rows = scripts.select(F.col("path").alias("src_path"), F.inline(F.arrays_zip(part(1).alias("word"), part(2).alias("what"), part(3).alias("target"))))
    braces = F.regexp_extract("what", r"\{([^}]*)\}", 1)
    default = F.regexp_extract("what", r"^([A-Za-z_$][\w$]*)\s*(?:,|$)", 1)
    names = import_names(F.concat_ws(",", braces, default))
    found = rows.select("src_path", "target", names.alias("names"), (F.col("word") == "export").alias("reexport")).distinct()
    return found.orderBy("src_path", "target", "names", "reexport")


_SYMBOL = (
    r"^\s*(export\s+)?(?:default\s+)?(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?"
    r"(class|function|interface|type|enum|def|func|fn|struct|trait|impl|mod)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)"
)
_KINDS = {"def": "function", "func": "function", "fn": "function", "struct": "class", "trait": "interface", "impl": "class", "mod": "module"}


def symbols(files: DataFrame, most: int = 1000) -> DataFrame:
    """path, kind, name, signature and line of declarations, by rule."""
    lines = files.select("path", F.posexplode(lines_of(F.col("content"))).alias("at", "text"))
    word, kind = F.regexp_extract("text", _SYMBOL, 2), F.regexp_extract("text", _SYMBOL, 2)
    for k, v in _KINDS.items():
        kind = F.when(word == k, v).otherwise(kind)
    found = lines.where(F.col("text").rlike(_SYMBOL)).select(
        "path",
        kind.alias("kind"),
        F.regexp_extract("text", _SYMBOL, 3).alias("name"),
        F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 160).alias("signature"),
        (F.col("at") + 1).cast("long").alias("line"),
        (F.regexp_extract("text", _SYMBOL, 1) != "").alias("exported"),
    )
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line", "signature"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def outline(files: DataFrame, detail: str = "complete") -> DataFrame:
    """Symbols of files: all (1,000 a file at most), or as a summary those at the margin
    (200 at most); their names follow from their signatures."""
    summary = detail == "summary"
    found = symbols(files.withColumn("content", F.regexp_replace("content", r"(?m)^[ \t].*$", "")) if summary else files, 200 if summary else 1000)
    return found.withColumn("name", symbol_name(F.col("signature")))


def lookup(files: DataFrame, marks: DataFrame, paths: list[str]) -> DataFrame:
    """path, hash and symbols (in order) of single indexed files; paths not indexed have no row."""
    own = files.where(F.col("path").isin(paths)).select("path", "hash")
    ordered = F.array_sort(F.collect_list(F.struct("line", "signature", "kind")))
    each = marks.where(F.col("path").isin(paths)).groupBy("path").agg(F.transform(ordered, lambda x: F.concat_ws(":", x["line"], x["kind"], x["signature"])).alias("symbols"))
    return own.join(each, "path", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


#: Layout of the stored index; another one is rebuilt.
VERSION = 1


def status(state: DataFrame, version: int = VERSION) -> DataFrame:
    """One row: files, bytes, the latest time of a file, and whether the layout of every record
    is the current one (column ``layout``; a state without it is of layout 1)."""
    layout = F.col("layout") if "layout" in state.columns else F.lit(1)
    return state.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.max("mtime").alias("latest"),
        F.coalesce(F.every(layout == version), F.lit(True)).alias("current"),
    )


def headings(files: DataFrame) -> DataFrame:
    """Symbols of prose: lines that start with a capital letter, named by their first word."""
    split = files.select("path", lines_of(F.col("content")).alias("all"))
    lines = split.select("path", F.size("all").alias("n"), F.posexplode("all").alias("at", "text"))
    named = lines.where(F.col("text").rlike("^[A-Z]"))
    return named.select(
        "path", F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("name"), (F.col("at") + 1).cast("long").alias("line"), F.col("n").cast("long").alias("n")
    )


def symbol_ranges(marks: DataFrame) -> DataFrame:
    """Adds last: the line before the next symbol, or the file's last."""
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line", "name"))
    return marks.select("path", "name", "line", F.coalesce(after - 1, F.col("n")).alias("last"))


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each (path, at) the symbol that contains it. ``ranges`` do not overlap within a
    file, so the last one that starts at or before a point is the only one that may."""
    starts = ranges.where("last >= line").select("path", F.col("line").alias("at"), F.lit(0).alias("kind"), F.struct("name", "line", "last").alias("s"))
    asked = points.select("path", "at").distinct().select("path", "at", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["s"].dataType).alias("s"))
    before = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("s", F.last("s", ignorenulls=True).over(before))
    return found.where("kind = 1 and at <= s.last").select("path", "at", "s.name", "s.line", "s.last")


def enclosing_ranges(spans: DataFrame, marks: DataFrame, cell: int = 64) -> DataFrame:
    """For each span (path, first, last) the symbol (name, line, last_line, signature) that
    contains it, else one that overlaps it: of least extent, then start, then signature.
    Symbols may nest; both sides are spread over cells of lines, so the join is an equal one."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(a, b) / cell))).alias("cell")
    left = spans.select("path", "first", "last").distinct().select("path", "first", "last", cells("first", "last"))
    right = marks.select("path", "name", "line", "last_line", "signature", cells("line", "last_line"))
    met = left.join(right, ["path", "cell"]).where("line <= last and last_line >= first")
    outside = ~((F.col("line") <= F.col("first")) & (F.col("last_line") >= F.col("last")))
    best = F.min(F.struct(outside.alias("outside"), (F.col("last_line") - F.col("line")).alias("extent"), "line", "signature", "name", "last_line")).alias("s")
    return met.groupBy("path", "first", "last").agg(best).select("path", "first", "last", "s.name", "s.line", "s.last_line", (~F.col("s.outside")).alias("contained"))
