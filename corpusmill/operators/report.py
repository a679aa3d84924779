"""Reports: timings, estimates before a run, likely files, omissions, cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import base_name


def timing_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """runs, average, least, greatest and 95th percentile (nearest rank) by group."""
    return rows.groupBy(by).agg(
        F.count(value).alias("runs"),
        F.round(F.avg(value), 4).alias("average"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
    )


def estimate(files: DataFrame, budget: int) -> DataFrame:
    """One row: files, bytes, tokens at four bytes each, and percent of the budget (100 at most)."""
    one = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    tokens = F.ceil(F.col("bytes") / 4).cast("long")
    return one.select("files", "bytes", tokens.alias("tokens"), F.least(F.lit(100), F.floor(100 * tokens / budget)).cast("long").alias("percent"))


def likely_files(files: DataFrame, terms: list[str], limit: int = 12) -> DataFrame:
    """path and score: ten for each term in the path, one for an entry point's name."""
    low = F.lower("path")
    hits = sum((F.contains(low, F.lit(t.lower())).cast("long") for t in terms), F.lit(0).cast("long"))
    entry = base_name(F.col("path")).rlike(r"^(main|index|app|server|cli)\.").cast("long")
    scored = files.select("path", (10 * hits + entry).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "path").limit(limit)


def omitted(found: DataFrame, per_file: int) -> DataFrame:
    """path, kept and omitted hits where a cap leaves some out."""
    n = found.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > per_file)
    return n.select("path", F.lit(per_file).cast("long").alias("kept"), (F.col("n") - per_file).alias("omitted"))


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path and whether its cached result still holds (same content)."""
    known = cache.select("path", "hash", F.lit(True).alias("hit")).distinct()
    return files.select("path", "hash").join(known, ["path", "hash"], "left").select("path", F.coalesce("hit", F.lit(False)).alias("hit"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` for each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def distinct_parts(rows: DataFrame, by: str, column: str) -> DataFrame:
    """``; ``-joined texts of a group as one, each part once, sorted."""
    parts = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(column, "; "), lambda x: x != "")))))
    return rows.groupBy(by).agg(F.array_join(parts, "; ").alias("parts"))


def dispatch_stats(calls: DataFrame) -> DataFrame:
    """tool, calls, ms and tokens of each tool and of all (tool null). calls: tool (not null), ms, tokens."""
    return calls.rollup("tool").agg(F.count("*").alias("calls"), F.sum("ms").alias("ms"), F.sum("tokens").alias("tokens"))
