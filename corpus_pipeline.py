"""From raw documents to tokens: five stages, each an operator of tarnlake.llm over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import mixing, ngram_join, pieces, quality, substring
from tarnlake.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, takes for good. Null and empty texts are judged by their
    (zero) statistics; rows that repeat fare alike. Without any label all stay."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest doc_id; one without an id only if none has one. Texts without words
    are alike to nothing and stay, each id and text once."""
    return ngram_join.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that an earlier one has; those without an id come last. Documents of which nothing
    is left go, empty ones stay; n_chars follows the text where it was cut."""
    columns = docs.columns
    found = substring.dedup(docs, with_text=True).filter("n_bytes = 0 or n_removed < n_bytes")
    text = F.col("kept_text")
    rest = {c: F.col("row")[c] for c in columns if c != "text"}
    if "n_chars" in rest:
        rest["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(rest["n_chars"])
    return found.select(*(text.alias(c) if c == "text" else rest[c].alias(c) for c in columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents repeated or left out as it says. Null is a source of its own; documents without words weigh nothing and stay."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; none for null and empty ones."""
    return pieces.encode(docs).select("row.doc_id", "row.source", "ids", "n_tokens")


STAGES = [("quality", keep_good), ("near_duplicates", one_of_each), ("repeats", cut_repeats), ("mix", mix_sources), ("tokens", tokenize)]

#: The classifier, the hashes and the token fold are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
