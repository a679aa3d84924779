"""Records of runs: stored by id, read back, explained and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import largest_first, valid_run_id
from corpusmill.operators.select import replayed

RECORD = (
    "run_id string, task string, budget long, estimated long, "
    "selection array<struct<path:string,mode:string,priority:string,rationale:string,score:long,breakdown:map<string,double>>>, "
    "degradations array<struct<step:string,reason:string,delta:long>>, dropped array<struct<path:string,reason:string>>"
)


def persist(records: DataFrame, folder: str) -> None:
    """Adds records as JSON, a folder for each run id; a run stored again replaces itself.
    Records whose id is no safe name are an error."""
    if records.where(~F.coalesce(valid_run_id(F.col("run_id")), F.lit(False))).limit(1).count():
        raise ValueError("a run id is no safe name")
    kept = records.select(F.col("run_id").alias("run"), "*")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(folder)


def read(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """The record of a run, by default of the latest: run ids start with their time."""
    rows = spark.read.schema(RECORD).json(folder)
    if run_id:
        return rows.where(F.col("run_id") == run_id)
    return rows.orderBy(F.desc("run_id")).limit(1)


def _steps(records: DataFrame) -> DataFrame:
    """run_id and the replayed degradations in order."""
    spread = records.select("run_id", F.posexplode("degradations").alias("ord", "d")).select("run_id", "ord", "d.*")
    keyed = spread.withColumn("ord", F.struct("run_id", F.col("ord").cast("long").alias("n")))
    return replayed(keyed).select("ord.run_id", F.col("ord.n").alias("ord"), "action", "path", "before", "after", "saved")


def explained(records: DataFrame) -> DataFrame:
    """run_id, path, mode, priority, score, why, breakdown (largest first) and degradations
    of each selected file, as texts."""
    chosen = records.select("run_id", F.explode("selection").alias("e")).select("run_id", "e.*")
    shown = F.array_join(F.transform(largest_first(F.col("breakdown")), lambda x: F.concat(x["label"], F.lit("="), F.floor(x["value"]))), ",")
    said = F.concat("action", F.lit(" "), F.coalesce("before", F.lit("n/a")), F.lit("->"), F.coalesce("after", F.lit("dropped")), F.lit(" "), "saved")
    each = F.array_sort(F.collect_list(F.struct("ord", said.alias("x"))))
    lost = _steps(records).where("path is not null").groupBy("run_id", "path").agg(F.array_join(F.transform(each, lambda s: s["x"]), "; ").alias("degradations"))
    return chosen.join(lost, ["run_id", "path"], "left").select(
        "run_id", "path", "mode", "priority", "score", F.col("rationale").alias("why"), F.coalesce(shown, F.lit("")).alias("breakdown"), F.coalesce("degradations", F.lit("")).alias("degradations")
    )


def dropped(records: DataFrame) -> DataFrame:
    """run_id, path and reason of the files left out: those recorded, then those that the
    budget cost; the first reason of a path counts."""
    given = records.select("run_id", F.posexplode("dropped").alias("n", "d")).select("run_id", "d.path", "d.reason", F.lit(0).alias("kind"), F.col("n").cast("long").alias("n"))
    cost = _steps(records).where("action = 'drop_codemap_only' and path is not null")
    cost = cost.select("run_id", "path", F.lit("budget degradation").alias("reason"), F.lit(1).alias("kind"), F.col("ord").alias("n"))
    return given.unionByName(cost).groupBy("run_id", "path").agg(F.min_by("reason", F.struct("kind", "n")).alias("reason"))


def manifest(records: DataFrame) -> DataFrame:
    """run_id, nth, path, mode and score of the selected files: best score first, those without one last."""
    chosen = records.select("run_id", F.explode("selection").alias("e")).select("run_id", "e.path", "e.mode", "e.score")
    order = Window.partitionBy("run_id").orderBy(F.col("score").desc_nulls_last(), "path")
    return chosen.select("run_id", F.row_number().over(order).cast("long").alias("nth"), "path", "mode", "score")


def report(records: DataFrame) -> DataFrame:
    """run_id, budget, estimated, files, saved and fits of each run."""
    saved = F.aggregate("degradations", F.lit(0).cast("long"), lambda acc, d: acc + d["delta"])
    return records.select(
        "run_id", "budget", "estimated", F.size("selection").cast("long").alias("files"), F.coalesce(saved, F.lit(0)).alias("saved"), (F.col("estimated") <= F.col("budget")).alias("fits")
    )


def target_misses(timings: DataFrame, targets: DataFrame) -> DataFrame:
    """scenario, name, value and target of the timings (scenario, name, value) above their targets (scenario, name, target)."""
    return timings.join(targets, ["scenario", "name"]).where(F.col("value") > F.col("target")).select("scenario", "name", "value", "target")


def section(rows: DataFrame, by: str, line: str) -> DataFrame:
    """The lines of each section as a bullet list; ``- none`` for a section without any."""
    listed = F.array_sort(F.collect_list(F.when(F.trim(line) != "", F.concat(F.lit("- "), F.trim(line)))))
    return rows.groupBy(by).agg(F.when(F.size(listed) == 0, "- none").otherwise(F.array_join(listed, "\n")).alias("text"))
