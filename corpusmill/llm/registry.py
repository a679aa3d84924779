"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpusmill.llm import chat, chunks, ctph, html, minhash, mixing, packing, pii, quality, resample, search, urlfilter, warc
from corpusmill.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_and_read(turns.unionByName(extra))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), list(urlfilter.RULES))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, similarity=0.8)


def op10_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_neighbours(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_mixing": op2_mixing,
        "op3_html": op3_html,
        "op4_quality": op4_quality,
        "op5_urlfilter": op5_urlfilter,
        "op6_warc": op6_warc,
        "op7_pii": op7_pii,
        "op8_packing": op8_packing,
        "op9_minhash": op9_minhash,
        "op10_ctph": op10_ctph,
        "op11_resample": op11_resample,
        "op12_search": op12_search,
        "op13_exact": op13_exact,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op2_mixing": mixing.MIX_SQL,
        "op5_urlfilter": urlfilter.JUDGE_SQL,
        "op6_warc": warc.WARC_SQL,
        "op9_minhash": minhash.NEAR_SQL,
        "op11_resample": resample.IMPORTANCE_SQL,
        "op12_search": search.RANKED_SQL,
        "op13_exact": chunks.EXACT_SQL,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
