"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adagium.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import html_text as h

    return h.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import quality_rules as q

    out = q.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import substring_dedup as d

    out = d.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20, start=10, rewrite=False)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept_sha256").alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import warc

    return warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import decontaminate as d

    return d.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import near_dup as n

    return n.classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import ordinal_quality as o

    scored = o.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "__quality.expected_grade", "__quality.tail_probability", "__quality.kept")


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import maxent_lm as m

    return m.score(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    from adagium.llm import byte_bpe as b

    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return b.encode(table(spark, sf_dir, "documents"), ranks_path, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adagium.llm import url_filter as u

    return u.filter_urls(table(spark, sf_dir, "pages"), u.outcomes_of(table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_quality_rules, op3_substring_dedup, op4_warc, op5_decontaminate, op6_near_dup, op7_ordinal_quality, op8_maxent_lm, op9_byte_bpe, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    from adagium.llm import oracles

    return oracles.all_sql()
