"""Helpers that the operators share: tables, cut lineage, running sums, components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words, and what a word is.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows that a key may have in one part of a join, and keys that are broadcast at most.
HOT_ROWS, MOST_BROADCAST = 512, 100_000

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else
    (a local session without that setting, as in tests) a folder of our own."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="corpusmill-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_tidy, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _tidy(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        remove_path(spark, path)


class Written:
    """A DataFrame written as Parquet in the shared folder and read back: its lineage
    ends there, so lost executors cost no recomputation. ``drop()`` deletes the files
    once nothing needs them."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove_path(self.spark, self.path)


class Scratch:
    """Written tables that are dropped together when the block of ``with`` ends."""

    def __init__(self):
        self.tables: list[Written] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Written(df, name))
        return self.tables[-1].df

    def __exit__(self, *_) -> None:
        for one in self.tables:
            one.drop()


def in_ranges(df: DataFrame, bucket: str, *order: str) -> Written:
    """``df`` written with a column ``bucket``: the number of the range of ``order`` that a
    row lies in. Spark picks the bounds from a sample, so that ranges hold about as many
    rows each; rows equal in ``order`` share one."""
    return Written(df.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id()), "ranges")


def hot_keys(counts: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame | None:
    """The keys of ``counts`` (keys, n) with over HOT_ROWS rows, and the parts to split
    each into; null if there are none. They are broadcast if they are few."""
    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("__parts")
    found = scratch(counts.where(F.col("n") > HOT_ROWS).select(*keys, parts), "hot")
    n = found.count()
    return F.broadcast(found) if 0 < n <= MOST_BROADCAST else found if n else None


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """The join (inner or left) of ``many`` rows with the few rows of ``one`` on ``keys``, where hot keys are
    split: rows of ``many`` go to a part by the digest of ``by``, those of ``one`` to all."""
    if hot is None:
        return many.join(one, keys, how)
    parts = F.coalesce("__parts", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = one.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def and_all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def running_sum(df: DataFrame, group: str, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each row of its ``group``.

    ``bucket`` must not decrease along ``order`` and, like ``group``, hold no nulls.
    Rows are summed within (group, bucket), then the few bucket totals within the
    group, so that a group with a third of all rows is spread over its buckets."""
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy(group, bucket)
        .agg(F.sum(value).alias("__total"))
        .select(group, bucket, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    )
    return (
        df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(totals, [group, bucket])
        .withColumn(out, F.col("__base") + F.col("__within"))
        .drop("__base", "__within")
    )


def components(edges: DataFrame, scratch: Scratch | None = None, most_rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b; any orderable type):
    (node, component), where component is the least node. Nodes without an edge to
    another node are absent. The result reads a table that ``scratch`` drops.

    Alternates large-star and small-star steps: each node hangs its larger
    neighbours, then its smaller ones, on its least neighbour. Every step is an
    aggregation with map-side combine and one join on its result, so that a node
    with a third of all edges is spread by the aggregation and by skew-join
    splitting. Each round is written to the shared folder."""
    scratch = scratch or Scratch()
    once = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch(once, "components")
    seen_before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = scratch(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "components")
        scratch.tables.pop(-2).drop()
        # A star forest is a fixed point; equal fingerprints of the edge set mean that one is reached.
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row[0] == 0 or row == seen_before:
            break
        seen_before = row
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
