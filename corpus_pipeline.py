"""A corpus pipeline over documents: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as
Parquet to the shared folder and reads it again as the next one's docs. All stages but the last keep
the columns of documents. n_chars follows the text where a stage changes it.

Rows are told apart by doc_id (null is an id like any other) and text, so of rows that repeat a doc_id
each is judged by its own text; rows equal in both go or stay together. Null, empty and letterless texts
go with the first stage. An empty table gives empty tables in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embralign.llm._base import Scratch, read_table
from embralign.llm._sample import held_out
from embralign.llm._tokens import tokenizer_path
from embralign.llm.decontaminate import contamination
from embralign.llm.language import identify
from embralign.llm.line_dedup import remove_repeated_lines
from embralign.llm.near_dedup import near_duplicates
from embralign.llm.pack import pack


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or letterless text) or with an unsure one go."""
    judged = identify(docs, docs.where(~held_out(F.col("doc_id"))))
    return judged.where("lang_pred <> 'und' and not (ambiguous and score < 0.5)").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; a document that loses every line goes too."""
    out = remove_repeated_lines(docs, least_words=1).where("not (n_removed > 0 and trim(text) = '')")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, text_key)."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one with the smallest doc_id (then text hash) stays."""
    return _without(docs, near_duplicates(docs, percent=80, least_agree=0.55).where("not first"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item (or a whole shorter item) go."""
    return _without(docs, contamination(docs, read_table(spark, sf_dir, "benchmark"), slack=0).where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens."""
    return pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", leak_stage), ("packing", packing_stage)]

#: Trained classifiers and tokenizers aren't expressible in SQL; a test holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
