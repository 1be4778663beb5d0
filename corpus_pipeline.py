"""A corpus clean-up over ``documents`` in five stages, each one operator of ``ferrule.llm``.

Every stage takes what its predecessor kept, written as Parquet and read again.  The first four return the
columns of their input; the last returns one row of token ids per document.

1. ``language_id``: documents without a language (null or no letter) or with an unsure one go.
2. ``jaccard_join``: of each group of near copies one row stays, that of smallest id (null last).
3. ``substring_dedup``: words under windows of 13 words that also start in a smaller document go; a document that loses
   words has the rest joined by one space, one that loses all its words goes, and any other is unchanged.
4. ``decontamination``: rows whose text leaks a benchmark item go, whatever their id.
5. ``byte_bpe``: ids of the text, checked by decoding them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import bpe, decontaminate, jaccard_join, language_id, repeats
from ferrule.session import cut_lineage
from ferrule.sources.tables import read_table

LEAST_SCORE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = language_id.train(docs.select("doc_id", "text", "lang"), vocabulary)
    found = language_id.identify(docs, model, vocabulary)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_group(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    columns = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
               "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars"))}
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             carry=F.struct("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")))
    return out.select("row.doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                      (F.col("decoded") == F.col("row.raw")).alias("round_trip"))


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: SQL cannot state the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut_lineage(docs)
    return docs
