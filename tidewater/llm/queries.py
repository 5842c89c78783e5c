"""The registered queries of this folder, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import editcount, hamming, html, langid, lexical, mixing, packing, pii, quality, simjoin, suffixes, turns, warc
from .common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, keep=["doc_id"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_pii(docs, keep=["doc_id"]))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality_rules(docs, keep=["doc_id"]).drop("class_distance", "word_distance")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search_table(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return editcount.count_edits(editcount.sample_edits(docs), keep=["doc_id"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(items, docs)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {f.__name__: f for f in (op1_html, op2_language, op3_suffix_dedup, op4_pii, op5_quality_rules, op6_pack, op7_ngram_jaccard_join, op8_hamming_search, op9_mix_sources, op10_edit_counts, op11_lexical_search, op12_turn_repair, op13_warc)}

ORACLE_SQL = {"op8_hamming_search": hamming.ORACLE_SQL, "op9_mix_sources": mixing.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL, "op12_turn_repair": turns.ORACLE_SQL, "op13_warc": warc.ORACLE_SQL}
