"""Line intervals: merging, capping, and slices chosen by task terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import lines_of
from corpusmill.operators.index import enclosing_ranges


def merged(intervals: DataFrame, gap: int = 1) -> DataFrame:
    """path, first and last of intervals merged where the next starts at most ``gap`` after the end.
    An interval without an end comes after the others of its start, one without a start after all."""
    order = Window.partitionBy("path").orderBy(F.asc_nulls_last("first"), F.asc_nulls_last("last"))
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") <= reach + gap, 0).otherwise(1)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = intervals.select("path", "first", "last").withColumn("fresh", fresh).withColumn("island", island)
    return marked.groupBy("path", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def capped(disjoint: DataFrame, most: int) -> DataFrame:
    """At most ``most`` intervals a path: the closest neighbours are joined first (the left
    ones of equal gaps), which is to close the smallest gaps."""
    order = Window.partitionBy("path").orderBy(F.asc_nulls_last("first"))
    gap = F.col("first") - F.lag("last").over(order)
    ranked = disjoint.select("path", "first", "last").withColumn("gap", gap).withColumn("n", F.count("*").over(Window.partitionBy("path")))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.asc_nulls_last("gap"), F.asc_nulls_last("first")))
    kept = F.when(F.col("gap").isNull() | (nth > F.col("n") - most), 1).otherwise(0)
    ranked = ranked.withColumn("fresh", kept)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("island", island).groupBy("path", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def for_hits(found: DataFrame, sizes: DataFrame, context: int = 30, most: int = 4) -> DataFrame:
    """Windows around hit lines (path, line), merged and capped; sizes: path, n (lines)."""
    near = found.join(sizes, "path").select(
        "path", F.greatest(F.lit(1), F.col("line") - context).alias("first"), F.least(F.col("n"), F.col("line") + context).alias("last")
    )
    return capped(merged(near), most)


def described(intervals: DataFrame, gap: int = 1) -> DataFrame:
    """path, first, last and description of intervals merged like ``merged``, their
    descriptions' distinct parts joined in the order of the intervals."""
    order = Window.partitionBy("path").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") <= reach + gap, 0).otherwise(1)
    marked = intervals.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "description"))), lambda x: F.split(x["description"], "; "))
    parts = F.array_distinct(F.filter(F.transform(F.flatten(each), lambda p: F.trim(p)), lambda p: p != ""))
    out = marked.groupBy("path", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_join(parts, "; ").alias("description"))
    return out.drop("island")


def budget_gap(context: int) -> int:
    """How far apart slices may be to be merged when their context shrinks."""
    return 1 if context <= 10 else max(2, context // 10)


def term_lines(files: DataFrame, terms: list[str]) -> DataFrame:
    """path, line and matched terms of the lines that hold any of them, whatever their case."""
    known = F.array(*[F.lit(t) for t in sorted({t.strip().lower() for t in terms if len(t.strip()) > 1})]).cast("array<string>")
    held = F.transform(lines_of(F.col("content")), lambda line, at: F.struct((at + 1).cast("long").alias("line"), F.filter(known, lambda t: F.contains(F.lower(line), t)).alias("matched")))
    return files.select("path", F.inline(F.filter(held, lambda x: F.size(x["matched"]) > 0)))


def for_terms(files: DataFrame, marks: DataFrame, terms: list[str], context: int = 30, most: int = 4) -> DataFrame:
    """Slices of each file: around its lines with terms, the symbol that encloses the line or
    else a window; without such lines, its first symbol, or a window at its start; merged and
    capped. marks: path, name, signature, line, last_line."""
    sizes = files.select("path", F.size(lines_of(F.col("content"))).cast("long").alias("n")).where("n > 0")
    hits = term_lines(files, terms).select("path", "line")
    start = marks.groupBy("path").agg(F.min("line").alias("line"))
    rest = sizes.join(hits.select("path").distinct(), "path", "left_anti").join(start, "path", "left").select("path", F.coalesce("line", F.lit(1)).cast("long").alias("line"))
    asked = hits.unionByName(rest).select("path", F.col("line").alias("first"), F.col("line").alias("last")).distinct()
    around = enclosing_ranges(asked, marks).select("path", "first", "last", F.col("line").alias("a"), F.col("last_line").alias("b"))
    placed = asked.join(around, ["path", "first", "last"], "left").join(sizes, "path")
    a = F.coalesce("a", F.greatest(F.lit(1), F.col("first") - context))
    b = F.coalesce("b", F.least(F.col("n"), F.col("last") + context))
    return capped(merged(placed.select("path", a.alias("first"), b.alias("last"))), most)
