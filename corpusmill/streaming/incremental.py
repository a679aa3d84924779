"""The index kept up to date from a stream of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from corpusmill.operators.index import merged

STATE = "path string, size long, mtime double, hash string"


def follow(scans: DataFrame, folder: str) -> DataStreamWriter:
    """Merges each batch of whole scans into versioned Parquet below ``folder``: version k+1
    is written from version k, so a batch that runs twice gives the same version. A version
    is deleted once the one after the next stands."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = version(spark, folder, number)
        merged(batch.select("path", "size", "mtime", "hash"), state).write.mode("overwrite").parquet(f"{folder}/v{number + 1}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return scans.writeStream.foreachBatch(step)


def version(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The state after so many batches."""
    if number <= 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/v{number}")
