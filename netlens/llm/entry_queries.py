"""The thin queries over the test tables: one a operator, whole tables, whole results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, shards=40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "tokens")
    write_token_files(docs, path, vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), end_id=0, most=2048)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_scan(docs).select("doc_id", "start", "length", "kind", "votes", "is_secret", F.sha2("value", 256).alias("value_sha256"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_index import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_transducer import encode_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "license", F.round("dice", 6).alias("dice"), "first_line", "n_lines")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_whitening import whitening

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening(vectors).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    docs = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}
