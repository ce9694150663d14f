"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, each on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.llm.common import durable, release, table, written
from voxcohort.llm.language import UNDEFINED, fit, held_out, identify
from voxcohort.llm.line_dedup import line_dedup
from voxcohort.llm.mixing import mix
from voxcohort.llm.near_dup import MOST_SENT, near_duplicates
from voxcohort.llm.packing import pack
from voxcohort.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of `documents`, n_chars following the text; others, if any, after them."""
    rest = [c for c in docs.columns if c not in COLUMNS]
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS, *rest)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`lang` becomes the predicted language; texts without any (null, or no letter) are rejected."""
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify(docs, model).where(F.col("lang_pred") != UNDEFINED)
    return columns_of(found.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them."""
    return columns_of(line_dedup(docs).drop("n_lines", "n_dropped"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    gone = durable(near_duplicates(docs, words=5, threshold=80).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return columns_of(docs.join(F.broadcast(gone) if gone.count() <= MOST_SENT else gone, "doc_id", "left_anti"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights."""
    found = mix(docs)
    return columns_of(found.where("selected").select(*docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return pack(docs, tokenizer("byte_bpe_50k.json"), kind="byte", end_id=0, capacity=1024)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mixture", mixture), ("sequences", sequences)]

#: Language ID, near-dedup and packing are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
            release(spark, mark, docs)  # of the stages so far only their result is read again
    return docs
