"""Corpora as DataFrames of files, from folders or from the tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import language, normal_path, stable_hash

#: Endings of the view over documents, by id.
ENDINGS = (".ts", ".py", ".go", ".rs", ".js", ".md", ".json")
#: File names of the view over documents, by id.
NAMES = ("main", "util", "index", "login_test", "routes", "model", "app", "helpers", "server", "config", "cli")
SNIFFED_BYTES = 8192


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder: path (relative), size, mtime (ms), hash, language,
    binary (a zero byte near the start) and content (null if binary)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.position(F.lit(root.rstrip("/").split(":", 1)[-1] + "/"), F.col("path"))
    path = normal_path(F.substring(F.col("path"), at + len(root.rstrip("/").split(":", 1)[-1]) + 1, F.lit(2**31 - 1)))
    zero = F.position(F.lit(bytes(1)), F.substring("content", 1, SNIFFED_BYTES)) > 0
    return files.select(
        path.alias("path"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1000).alias("mtime"),
        stable_hash(F.col("content"), 64).alias("hash"),
        language(path).alias("language"),
        zero.alias("binary"),
        F.when(~zero, F.decode("content", "UTF-8")).alias("content"),
    )


def files_of_documents(docs: DataFrame) -> DataFrame:
    """Documents as files of repositories: path, size, mtime, hash, language, content, doc_id."""
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS)).cast("int"))
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES)).cast("int"))
    folder = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    files = docs.select(
        F.concat(folder, F.lit("/"), name, ending).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("doc_id").cast("double").alias("mtime"),
        stable_hash(F.col("text")).alias("hash"),
        F.col("text").alias("content"),
        "doc_id",
    )
    return files.withColumn("language", language(F.col("path")))


FILES_SQL = """files as (
  select *, case regexp_extract(path, '\\.([^./]+)$', 1) when 'ts' then 'typescript' when 'py' then 'python' when 'go' then 'go'
    when 'rs' then 'rust' when 'js' then 'javascript' when 'md' then 'markdown' when 'json' then 'json' else 'text' end as language
  from (
    select source || '/' || lang || '/d' || lpad(doc_id::varchar, 12, '0') || '/' ||
      (['main', 'util', 'index', 'login_test', 'routes', 'model', 'app', 'helpers', 'server', 'config', 'cli'])[(doc_id % 11 + 1)::int] ||
      (['.ts', '.py', '.go', '.rs', '.js', '.md', '.json'])[(doc_id % 7 + 1)::int] as path,
      strlen(text)::bigint as size, doc_id::double as mtime, substr(sha256(text), 1, 12) as hash, text as content, doc_id
    from documents)
)"""
