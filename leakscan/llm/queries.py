"""Registered queries of the operators of this package, with production parameters, each
over its whole table; and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bpe, cap_filters, chat, code_compress, minhash, mixing, oracle_sql, packing, periodic_runs, quality,
               suffix_dedup, token_file, toxicity, url_rules)
from .common import table

QUERIES: dict = {}


def _register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@_register("op1_token_file")
def op1(spark, sf_dir):
    """Token-ID blocks with Elias-Fano boundaries, written and read back."""
    d = token_file.write_and_read(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, with_ids=False)
    return d.select("doc_id", "start", "n_tokens", "ids_crc32")


@_register("op2_url_rules")
def op2(spark, sf_dir):
    """Every page URL by fixed rules, else by rules mined from the labels of pages."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # a page is labelled by the document whose number stands in its URL
    bad = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled = url_rules.document_number(url_rules.split(pages.select("url"))).join(bad, "doc_id").select("tokens", "bad")
    fixed = url_rules.fixed_rules(spark, [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")])
    return url_rules.judge(pages, fixed, url_rules.mine(labelled)).select("page_id", "host", "path", "rule", "verdict")


@_register("op3_toxicity")
def op3(spark, sf_dir):
    """Toxicity score of every text, learned from labels that are not held out."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register("op4_cap_filters")
def op4(spark, sf_dir):
    """Links and components of all embeddings at cosine 0.95."""
    return cap_filters.similar_vectors(table(spark, sf_dir, "embeddings"))


@_register("op5_byte_bpe")
def op5(spark, sf_dir):
    """Byte-level BPE ids of every text, and the bytes decoded from them."""
    import public_tokenizers
    path = _tokenizer("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN), path)


@_register("op6_dart_minhash")
def op6(spark, sf_dir):
    """Class of exact copies and component of near duplicates for every document."""
    return minhash.per_row(minhash.near_duplicates(table(spark, sf_dir, "documents")))


@_register("op7_chat_format")
def op7(spark, sf_dir):
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(own)), ordered=True)


@_register("op8_suffix_dedup")
def op8(spark, sf_dir):
    """Bytes of 100-byte strings that start earlier elsewhere, removed from every document."""
    return suffix_dedup.digests(suffix_dedup.spans(table(spark, sf_dir, "documents")))


@_register("op9_source_mix")
def op9(spark, sf_dir):
    """All documents mixed by source weights 1, 2, 3."""
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_register("op10_quality_rules")
def op10(spark, sf_dir):
    """Base counts and the verdict of the divergence rules for every document."""
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_register("op11_periodic_runs")
def op11(spark, sf_dir):
    """Runs of repeated words in every document, and the text without the repetitions."""
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


@_register("op12_vector_codes")
def op12(spark, sf_dir):
    """Codes of all embeddings by exact integer codebooks, with errors by row and label."""
    return code_compress.with_label_error(*code_compress.compress(table(spark, sf_dir, "embeddings")))


@_register("op13_mixture_packing")
def op13(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens, each window in the proportions of the sources."""
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def oracles() -> dict[str, str]:
    """SQL by query; the others have none, and tests hold them against brute force or the public library."""
    return {"op7_chat_format": oracle_sql.chat_sql(), "op10_quality_rules": oracle_sql.quality_sql(),
            "op12_vector_codes": oracle_sql.codes_sql()}
