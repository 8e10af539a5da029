"""One thin query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract, fit_extractor

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit_extractor(pages)).select("page_id", "url", "text", "n_chars")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer()).drop("ids")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return classify(docs, table(spark, sf_dir, "labels"), with_text=False).select("doc_id", held_out, "score", "predicted")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), shingle=4)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("hit_items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import with_neighbours

    return with_neighbours(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer()).drop("text")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_text=False)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import corpus_words, variants

    return variants(corpus_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import chat, lexical_search, oracles

    return {
        "op1_chat_rotation": chat.ORACLE,
        "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op6_near_dedup": oracles.NEAR_DEDUP,
        "op7_decontamination": oracles.DECONTAMINATION,
        "op12_ranked_search": lexical_search.ORACLE,
    }
