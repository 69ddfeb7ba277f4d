"""Queries of the training-data operators, over whole tables with production
parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.llm import chat, oracle
from gridwatch.llm.common import read
from gridwatch.llm.embedding_dedup import embedding_components
from gridwatch.llm.filter_audit import audit
from gridwatch.llm.html_text import extract_text
from gridwatch.llm.langid import identify
from gridwatch.llm.lz_fingerprint import neighbour_fingerprints
from gridwatch.llm.mixing import mix_sizes
from gridwatch.llm.packing import pack
from gridwatch.llm.part_trie import compress
from gridwatch.llm.simhash_dedup import simhash_components
from gridwatch.llm.substring_dedup import dedup_substrings
from gridwatch.llm.suffix_dedup import remove_repeats
from gridwatch.llm.toxicity import toxicity

#: What both turns of conversation -1 say.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and likenesses."""
    return neighbour_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(rows).select("doc_id", "held_out", "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_components(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(documents, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    mixed = mix_sizes(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept words of every document."""
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_part_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, errors by label, digest of the codebooks."""
    return compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and runs, and a digest of the kept bytes of every document."""
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every step of every order of the five filters keeps and removes, by language."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(documents, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lz_fingerprint": op1_lz_fingerprint,
    "op2_language_id": op2_language_id,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_part_trie": op11_part_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = oracle.SQL
