"""Registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import ann, chat, decontam, fim, jaccard, langid, licences, lm, merkle, packing, pii, quality, warc
from rosterline.llm.common import read_table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(read_table(spark, sf_dir, "documents"))


def op2_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read_table(spark, sf_dir, "documents"))


def op4_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read_table(spark, sf_dir, "documents"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read_table(spark, sf_dir, "documents"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read_table(spark, sf_dir, "conversations")
    return chat.chat_records(messages, *chat.derived_calls(messages), chat.tools_frame(spark))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(read_table(spark, sf_dir, "pages"))
    return warc.parse(warc.read_records(spark, path)).drop("url", "payload")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read_table(spark, sf_dir, "documents"), proofs=False)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_quality_perplexity, op3_licence_rules, op4_private_spans, op5_learned_partitions,
    op6_decontamination, op7_language_id, op8_harmonic_packing, op9_trie_scores, op10_tool_calls,
    op11_fill_in_middle, op12_content_archive, op13_merkle_manifest)}
SQL = {"op6_decontamination": decontam.ORACLE, "op10_tool_calls": chat.ORACLE,
       "op11_fill_in_middle": fim.ORACLE, "op12_content_archive": warc.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
