"""The corpus pipeline: its stages in order, each reading what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, neardup, quality
from quire.llm.common import WORD, drop_since, mark, spill, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mixture: these weights (1 where not named), four fifths of the tokens there are, and no text
#: more than twice.
WEIGHTS = {"domain": {"domain0": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}, "source": {"src0": 0.5}}
SHARE, EPOCHS = 0.8, 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score at least 0.7). It learns from
    the labelled rows that are left in docs. A null text counts as empty; null and repeated ids are
    judged each by its text; without labels every score is one half and nothing stays."""
    model = quality.train(quality.sample(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") >= 0.7).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id. Rows of one id
    are one document: the one of the smallest text stays. Rows without an id all stay."""
    given = docs.select(*COLUMNS)
    if not given.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        first = F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")
        given = spill(given.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first).select("doc_id", "r.*").select(*COLUMNS).unionByName(given.where("doc_id IS NULL")), "pipeline-rows")
    gone = neardup.link(given).where("NOT kept").select(F.col("doc_id").alias("gone"))
    return given.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: a row for each epoch that takes a document. A document that is cut
    holds its first words, joined by spaces. Rows without an id or without words are not taken."""
    taken = mixing.mix(docs.where("doc_id IS NOT NULL"), WEIGHTS, share=SHARE, epochs=EPOCHS).select(F.col("doc_id").alias("id"), "tokens", "taken")
    both = docs.select(*COLUMNS).join(taken, F.col("doc_id") == F.col("id"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < F.col("tokens"), cut).otherwise(F.col("text"))
    return both.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("taken") < F.col("tokens"), F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to; a row for each row, a null
    text counts as empty."""
    given = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = bpe.encode(given, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: A trained classifier and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs, began = table(spark, sf_dir, "documents"), mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spill(docs, f"pipeline-{name}")
            drop_since(spark, began, docs)  # nothing that follows reads them
    return docs
