"""The corpus pipeline: documents in, token ids of a cleaned and mixed corpus out.

STAGES are (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it back, so a lost executor costs
one stage's tasks at most.

Edge cases, alike in all stages: null ids and null or empty texts pass through and break nothing (mixing leaves texts without words
out, as there is nothing to take of them); texts are taken whole, however long; other columns pass through unused, whatever their
names; an empty table gives an empty result. Repeated rows are told in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.bpe import encode_documents
from orrery.llm.common import small_batches, stage
from orrery.llm.jaccard_join import keep_one
from orrery.llm.line_dedup import dedup_lines
from orrery.llm.mixing import mixed_documents
from orrery.llm.quality import keep_good
from orrery.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Repeated rows stand or fall together; equal weights at the cut stay."""
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; n_chars counted anew.

    All rows stay, though some with an empty text. Repeated rows of one id and text keep the same lines.
    """
    out = dedup_lines(docs, count=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (null last).

    Repeated rows of one id and text become one; texts without words are no one's duplicates.
    """
    small_batches(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes, a row for each document, epoch and run of neighbouring blocks.

    Rows of one id, text and source are mixed as rows of their own.
    """
    small_batches(spark)
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's whole text, and digests of them and of their decoding. A null text has no ids."""
    small_batches(spark)
    return encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: No stage but the exact ones can be told in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
