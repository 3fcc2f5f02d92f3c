"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import expand_turns, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(expand_turns(rows))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_components

    return similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "rate", "n_copies", "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file; the folder can be given as TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import scratch_dir
    from .warc import read_warc, write_warc

    out = scratch_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import document_leaves, manifest

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(document_leaves(table(spark, sf_dir, "documents"), tampered), with_proof=False)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat, op2_jaccard, op3_rules, op4_mix, op5_tokens, op6_substring, op7_toxicity, op8_decontam, op9_warc, op10_quality, op11_repair, op12_manifest, op13_fingerprints)}
