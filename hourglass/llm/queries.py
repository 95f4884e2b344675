"""The registered queries of this subpackage: one ``opN_*`` each, over whole
tables, with the operator's production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, common, decontaminate, host_quality, langid, near_dedup, packing, quote_links, spelling,
               suffix_dedup, toxicity, unigram_counts, url_rules, window_dedup)
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_hgl_id").alias("doc_id"), "n_words", decontaminate.n_hit().alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram_counts.token_counts(docs, drop_text=True).select(
        "doc_id", F.col("_hgl_pretokens").alias("n_pretokens"), F.col("_hgl_tokens").alias("n_tokens"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.cut_repeats(docs, keep_text=False)
    return out.select("doc_id", *(F.col(f"_hgl_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = host_quality.judge(docs, drop_text=True)
    return out.select("doc_id", *(F.col(f"_hgl_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(common.fold("doc_id", 5) != 0)
    out = toxicity.score(docs, toxicity.fit(docs, labels), drop_text=True)
    return out.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), F.col("_hgl_score").alias("score"),
                      F.when(F.col("_hgl_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.threads(table(spark, sf_dir, "conversations")).drop("links")


def _quote_levels(messages: DataFrame) -> DataFrame:
    out = quote_links.threads(messages).where("links is not null").select("conv_id", "turn", "role", F.explode("links").alias("x"))
    return out.select("conv_id", "turn", "role", F.col("x.level").cast("bigint").alias("level"),
                      F.col("x.conv").alias("to_conv"), F.col("x.turn").alias("to_turn"))


def op7_quote_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all quote levels, a row each."""
    return _quote_levels(table(spark, sf_dir, "conversations"))


def op7_reply_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over messages that quote: the given ones hold no quotes, so Spark adds those of the messages before."""
    return _quote_levels(common.save(quote_links.replies(table(spark, sf_dir, "conversations")), "replies"))


def op7_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered conversations, a row a thread (and part), of messages that quote."""
    messages = common.save(quote_links.replies(table(spark, sf_dir, "conversations")), "replies")
    return quote_links.conversations(messages).drop("messages")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(common.fold("doc_id", 4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model, drop_text=True)
    return out.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), F.col("_hgl_lang").alias("lang_pred"),
                      F.col("_hgl_score").alias("score"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.groups(docs).select("doc_id", F.col("_hgl_n").alias("n_shingles"),
                                          F.col("_hgl_component").alias("component_id"), F.col("_hgl_kept").alias("kept"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(url_rules.RULES), "host string, path string, verdict string")
    return url_rules.apply_rules(pages, rules).select(
        "page_id", *(F.col(f"_hgl_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def op11_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = window_dedup.cut_windows(docs, keep_text=False)
    return out.select("doc_id", *(F.col(f"_hgl_{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_suffix_dedup, op4_host_quality, op5_toxicity, op6_pack,
                            op7_quote_links, op7_quote_levels, op7_reply_levels, op7_conversations, op8_langid, op9_near_dedup, op10_url_rules,
                            op11_window_dedup, op12_spelling, op13_collocations)
}
ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op3_suffix_dedup": suffix_dedup.ORACLE, "op4_host_quality": host_quality.ORACLE,
                           "op7_quote_links": quote_links.oracle(), "op7_quote_levels": quote_links.levels_oracle(),
                           "op7_reply_levels": quote_links.levels_oracle(quote_links.REPLIES),
                           "op7_conversations": quote_links.conversations_oracle(quote_links.REPLIES),
                           "op9_near_dedup": near_dedup.ORACLE,
                           "op10_url_rules": url_rules.ORACLE, "op11_window_dedup": window_dedup.ORACLE,
                           "op12_spelling": spelling.ORACLE, "op13_collocations": collocations.ORACLE}
