"""From raw documents to token ids, in stages that each work on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherline.llm import bpe, langid, mixing, neardup, secret_scan
from gatherline.llm.common import row_key, saved, table
from gatherline.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (no letter, null or empty text, or too narrow a margin); a lang that is null becomes the predicted one. A row for each row that stays."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.fit(docs, F.lit(True)), COLUMNS)
    return found.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the least doc_id (null last), of several such rows any one that reads least as a hash.

    Rows that repeat each other are one; rows without an id take part like others; rows with null or empty texts are near to nothing but rows that repeat them."""
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("key", row_key(docs))
    kept = saved(neardup.groups(keyed.select("key", "doc_id", "text")).where("key = first").select("key").distinct())
    return keyed.join(kept.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mask; n_chars follows (null texts stay null). A row for each row."""
    docs = docs.select(*COLUMNS)
    found = secret_scan.scan(docs, secret_scan.fit(docs), ["doc_id", "text", "lang", "source"], redact=True)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws blocks of words to the sources' targets: a row for each row and pass, with the words that the mix takes; rows without a word go."""
    return mixing.mixed_texts(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to (null text: none, and empty). A row for each row."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    found = bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN, ["doc_id", "lang", "source", "text"])
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]
#: Compression, grammar inference and keyed permutations have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
