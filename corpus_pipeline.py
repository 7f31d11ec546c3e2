"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe_duckdb import coding_report
from textloom.llm.decontaminate import keep_uncontaminated
from textloom.llm.line_dedup import keep_new_lines
from textloom.llm.ordinal_quality import keep_good
from textloom.llm.queries import vocabulary
from textloom.llm.shared import materialize, read_table
from textloom.llm.similar_text import keep_one_of_similar
from textloom.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go unless the classifier gives the highest grade a probability of one half.

    All columns stay as they are.  A null text is judged as an empty one, whole texts at any length; equal
    texts are judged alike, repeated rows and null ids included.  Without labels all documents stay, and an
    empty table stays empty.
    """
    ship_package(spark)
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go, and documents of which nothing is left.

    ``text`` and ``n_chars`` are those of what is left, further columns of any name stay.  The first
    occurrence is that of the least id (null is the least); null and empty texts are one empty line, of which
    the first stays.  Rows equal in id and text stay or go together.  An empty table stays empty.
    """
    kept = keep_new_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word similarity of 0.8 stays: that of the least id.

    SimHash candidates are verified and completed to all such links.  All columns stay.  Null ids are the
    greatest; texts that share an id are told apart, and of rows equal in id and text one stays.  Null, empty
    and blank texts are one component.  Whole texts count.  An empty table stays empty.
    """
    ship_package(spark)
    return keep_one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    All columns stay.  Null and empty texts hold none and stay; whole texts count; rows that share an id are
    judged each by its text, repeated rows alike.  An empty benchmark keeps all, and an empty table stays empty.
    """
    return keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left, one row for each row.

    A null text is empty and has no ids; whole texts are encoded at any length; other columns are ignored; an
    empty table stays empty.
    """
    ship_package(spark)
    return coding_report(docs, vocabulary("byte_bpe_50k.tiktoken"), PATTERN)


STAGES = [
    ("ordinal_quality", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_duckdb", tokens),
]

#: Training a classifier cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
