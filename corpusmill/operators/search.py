"""Content search with context, grouping and caps; reading lines and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import extension, lines_of, matches_any, truncate

PER_FILE, OVERALL = 20, 100


def hits(files: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False, context: int = 0) -> DataFrame:
    """path, line, col, excerpt, before and after of every line that holds the pattern (once
    a line). Lines are filtered and given their context within a file, before they are rows."""

    def place(line: Column) -> Column:
        if regex:
            return F.regexp_instr(line, F.lit(pattern if case_sensitive else f"(?i){pattern}"))
        return F.position(F.lit(pattern), line) if case_sensitive else F.position(F.lit(pattern.lower()), F.lower(line))

    def shown(x: Column) -> Column:
        first = F.greatest(x["at"] - context, F.lit(0))
        return F.struct(
            (x["at"] + 1).cast("long").alias("line"),
            x["col"].cast("long").alias("col"),
            x["excerpt"].alias("excerpt"),
            F.slice("all", first + 1, x["at"] - first).alias("before"),
            F.slice("all", x["at"] + 2, F.lit(context)).alias("after"),
        )

    split = files.select("path", lines_of(F.col("content")).alias("all"))
    marked = F.transform("all", lambda line, at: F.struct(at.alias("at"), place(line).alias("col"), line.alias("excerpt")))
    found = F.transform(F.filter(marked, lambda x: x["col"] > 0), shown)
    return split.select("path", F.inline(found))


def capped(found: DataFrame, per_file: int = PER_FILE, overall: int = OVERALL) -> DataFrame:
    """The first hits of each file, and of those the first overall by path and line."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return found.withColumn("nth", nth).where(F.col("nth") <= per_file).drop("nth").orderBy("path", "line").limit(overall)


def grouped(found: DataFrame, excerpts: int = 3, most_files: int = 50, width: int = 80) -> DataFrame:
    """path, hits and its first excerpts, for the files of most hits."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    few = found.withColumn("nth", nth)
    shown = F.when(F.col("nth") <= excerpts, F.struct("nth", F.concat(F.col("line"), F.lit(":"), truncate(F.col("excerpt"), width)).alias("x")))
    each = few.groupBy("path").agg(F.count("*").alias("hits"), F.sort_array(F.collect_list(shown)).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["x"]), "\n")
    return each.select("path", "hits", text.alias("excerpts")).orderBy(F.desc("hits"), "path").limit(most_files)


def content_and_paths(files: DataFrame, term: str) -> DataFrame:
    """path and hits: lines with the term, plus one if the path holds it."""
    content = hits(files, term).groupBy("path").agg(F.count("*").alias("c"))
    paths = files.where(F.contains(F.lower("path"), F.lit(term.lower()))).select("path", F.lit(1).alias("p"))
    both = content.join(paths, "path", "full_outer")
    return both.select("path", (F.coalesce("c", F.lit(0)) + F.coalesce("p", F.lit(0))).cast("long").alias("hits"))


def paths(files: DataFrame, pattern: str, regex: bool = False, endings=(), include=(), exclude=(), under: str = ".", limit: int = 50) -> DataFrame:
    """The first paths that hold the pattern (a literal of any case, or a regex as given),
    of the given endings, named by any include glob and by no exclude glob, below a folder."""
    p = F.col("path")
    hit = p.rlike(pattern) if regex else F.contains(F.lower(p), F.lit(pattern.lower()))
    kept = files.select("path").where(hit & subtree(p, under))
    if endings:
        kept = kept.where(extension(p).isin([e.lower().lstrip(".") for e in endings]))
    if include:
        kept = kept.where(matches_any(p, list(include)))
    return kept.where(~matches_any(p, list(exclude))).distinct().orderBy("path").limit(limit)


def subtree(path: Column, under: str) -> Column:
    """Whether a path is the given one or lies below it; ``.`` holds all."""
    under = under.rstrip("/")
    return F.lit(True) if under in ("", ".") else (path == under) | path.startswith(f"{under}/")


def expanded(files: DataFrame, asked: DataFrame) -> DataFrame:
    """asked and path: the files that each asked path names or holds, or path null if none.
    Each file meets the folders above it by an equal join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    spread = files.select("path", F.explode(F.concat(F.array(F.lit(".")), above)).alias("asked"))
    return asked.select(F.regexp_replace("asked", "(?<=.)/$", "").alias("asked")).distinct().join(spread, "asked", "left").select("asked", "path")


#: Lines that strict privacy shows of a file at most.
STRICT_LINES = 20


def shown_lines(first: int, limit: int | None, strict: bool = False) -> tuple[int, int]:
    """First and last line of a read; strict privacy caps its length."""
    if strict:
        limit = min(STRICT_LINES if limit is None else limit, STRICT_LINES)
    return max(1, first), 2**31 - 1 if limit is None else max(1, first) + max(0, limit) - 1


def numbered_lines(files: DataFrame, first: int, last: int, width: int = 4) -> DataFrame:
    """path, line and text with a padded number, for the lines first to last."""
    lines = files.select("path", F.posexplode(lines_of(F.col("content"))).alias("at", "text"))
    kept = lines.where((F.col("at") + 1).between(first, last))
    number = (F.col("at") + 1).cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, " ")).otherwise(number)
    return kept.select("path", (F.col("at") + 1).cast("long").alias("line"), F.concat(padded, F.lit(" | "), "text").alias("text"))


def snippet(files: DataFrame, anchor: str, around: int = 8) -> DataFrame:
    """path, anchor line and text of the lines around the first that holds the anchor."""
    lines = lines_of(F.col("content"))
    found = files.select("path", lines.alias("all")).withColumn(
        "at", F.array_position(F.transform("all", lambda x: F.contains(x, F.lit(anchor))), True)
    )
    first = F.greatest(F.col("at") - around, F.lit(1))
    text = F.array_join(F.slice("all", first.cast("int"), (F.col("at") + around - first + 1).cast("int")), "\n")
    return found.where("at > 0").select("path", F.col("at").cast("long").alias("line"), text.alias("text"))
