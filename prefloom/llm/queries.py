"""The registered query of each operator: its contract's columns, derived from
the operator's own results over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm import (bpe_lexicon, conversation_repair, fast_minhash, html_ratio, pareto_mix, pii_disclosure, ppm_langid, quality_table,
                          rans_output, rp_forest, sparse_suffix, spelling_variants, token_counts)
from prefloom.sources.tables import read_table


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = bpe_lexicon.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ppm_langid.identify(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(read_table(spark, sf_dir, "documents"))


def op4_rans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rans_output.written(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = pareto_mix.plan_mix(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op7_fast_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fast_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op8_html_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_ratio.extract(read_table(spark, sf_dir, "pages"))


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_disclosure.personal_data(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"),
                      "spans", "n_term")


def op10_quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_table.judge(read_table(spark, sf_dir, "documents"), keep=["doc_id"], lang="lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, present=F.col("present"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants.misspelt(spelling_variants.runs(read_table(spark, sf_dir, "documents")))
    return spelling_variants.group_variants(spelling_variants.vocabulary(found))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_bpe_lexicon, op2_ppm_langid, op3_sparse_suffix, op4_rans_output, op5_rp_forest, op6_pareto_mix, op7_fast_minhash,
    op8_html_ratio, op9_pii_disclosure, op10_quality_table, op11_conversation_repair,
    op12_token_counts, op13_spelling_variants, pipeline)}
