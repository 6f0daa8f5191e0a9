"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldshift.llm import embedding_dedup, fill_middle, html_text, licenses, line_dedup, maxent, merkle, mixing, quality, sentencepieces, simhash, sql
from fieldshift.llm import substring_dedup, url_filter
from fieldshift.llm.tables import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and removed per document: n_lines, n_removed, SHA-256 of the kept text."""
    return line_dedup.digest(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page; a page is labelled by the row of ``labels`` with its id, bad if of low quality or toxic."""
    labels = read(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0
    )
    judged = url_filter.judge(read(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.parse(read(spark, sf_dir, "documents"), texts=False).drop("factors")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(docs, keep_text=False).select("doc_id", *[f"__q.{c}" for c in fields])


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(read(spark, sf_dir, "documents"))
    root = merkle.folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    proof = F.sha2(merkle.siblings(F.col("path")), 256)
    checked = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extracted(read(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.rewritten(read(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restored()).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_line_dedup,
        op3_url_filter,
        op4_substring_dedup,
        op5_mixing,
        op6_lm_scoring,
        op7_simhash_dedup,
        op8_quality_rules,
        op9_sentencepiece,
        op10_license_scan,
        op11_merkle_manifest,
        op12_html_extract,
        op13_fill_middle,
    )
}
ORACLES = {"op2_line_dedup": sql.LINE_DEDUP, "op3_url_filter": sql.URL_FILTER, "op8_quality_rules": sql.QUALITY, "op11_merkle_manifest": sql.MERKLE, "op13_fill_middle": sql.FILL_MIDDLE}
