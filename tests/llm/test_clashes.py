"""Stages and operators keep documents' extra columns, whatever their names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import chunks, common, minhash, resample, search

NAMES = ("id", "same", "size", "first", "last", "slot", "source_no", "row_no", "epoch", "key", "rep", "kept", "n_words", "word_chars", "base_failed", "digest", "n", "block", "label", "quality", "row", "score", "rank", "comp", "target")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    every = common.table(spark, sf_dir, "documents")
    extra = every.select("*", *[F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")).alias(name) for name in NAMES])
    return common.Written(extra.unionByName(extra.limit(3)).unionByName(extra.limit(2).withColumn("text", F.lit(None).cast("string"))), "clashes").df


def applied(name, spark, docs, sf_dir):
    if name == "chunks":
        return chunks.apply(docs)
    if name == "resample":
        return resample.apply(docs, common.table(spark, sf_dir, "benchmark"))
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


@pytest.mark.parametrize("name", ["quality rules", "near duplicates", "personal data", "source mix", "chunks", "resample"])
def test_extra_columns_stay(name, spark, docs, sf_dir):
    out = applied(name, spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.select("doc_id", *NAMES).collect()
    assert rows and all(r[k] == f"{k}-{r.doc_id}" for r in rows for k in NAMES)


@pytest.mark.parametrize("name", ["quality rules", "near duplicates", "personal data", "source mix", "chunks", "resample"])
def test_empty_tables_stay_empty(name, spark, docs, sf_dir):
    assert applied(name, spark, docs.limit(0), sf_dir).collect() == []




@pytest.mark.parametrize("text", [None, "", " \n"])
def test_tables_of_texts_without_words(spark, sf_dir, text):
    rows = spark.createDataFrame([(k, text, "en", "s", 0) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.keep_id, r.group_size) for r in chunks.exact_duplicates(rows).collect()} == {(4, 5)}
    found = resample.importance(rows, common.table(spark, sf_dir, "benchmark")).collect()
    assert {(r.n_features, r.weight, r["rank"]) for r in found} == {(0, 0, None)}
    assert search.ranked(rows, common.table(spark, sf_dir, "benchmark")).collect() == []
    assert minhash.near_duplicates(rows).where("kept").count() == 5
