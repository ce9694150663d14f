"""Queries of the corpus operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, durable_path, table, text_or_empty
from .embedding_dedup import embedding_duplicates
from .language import fit, held_out, identify
from .line_dedup import line_dedup
from .media import feature_of, read, store
from .mixing import mix
from .near_dup import near_duplicates
from .packing import pack
from .sharding import shard
from .suffix_dedup import suffix_dedup
from .token_files import read_tokens, write_tokens


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("cell_weight", 6).alias("cell_weight"), F.round("probability", 6).alias("probability"), "selected")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), kind="byte", end_id=0, capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = durable_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), kind="word", end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(text_or_empty(), "utf-8"), 256).alias("kept_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def padded(text: Column, unit: int = 576) -> Column:
    """The text's UTF-8 bytes with bytes 255 up to a positive multiple of `unit`."""
    data = F.encode(text, "utf-8")
    n = F.octet_length(data)
    size = F.greatest(F.lit(unit), F.ceil(n / unit) * unit)
    return F.concat(data, F.unhex(F.repeat(F.lit("ff"), (size - n).cast("int"))))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"), padded(text_or_empty()).alias("payload"))
    stored = durable(store(rows, F.col("payload")).drop("payload"), "media")  # the stored form is written, and read back
    rows = read(stored, F.col("media"))
    back = F.col("stream.payload")
    return rows.select(
        "doc_id", "n_bytes", F.octet_length(back).cast("bigint").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"), F.crc32(F.substring(back, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature_of(F.col("stream")).alias("feature"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"))
    model = fit(docs, F.col("doc_id").isNotNull() & ~apart)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, threshold=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_pack": op2_pack,
    "op3_token_files": op3_token_files,
    "op4_line_dedup": op4_line_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_media": op6_media,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_shard": op8_shard,
    "op9_language": op9_language,
    "op10_near_dup": op10_near_dup,
}
