"""A training corpus from raw documents, stage by stage.

Documents that the toxicity classifier rejects go; of each group of near
duplicates one stays; documents contaminated by the benchmark go; secrets are
replaced within texts; what is left is encoded. Every stage reads the table
that the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, decontam, neardup, secrets, toxicity
from sessionloom.llm.queries import table, vocabulary
from sessionloom.llm.scratch import Scratch, swept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows, all columns, that the classifier scores under 0.5.

    It is fitted on ``docs`` and ``labels``, outside the held-out fold. Null and
    empty texts have the score of no words; repeated rows are judged alike.
    Without labels of both kinds all rows have one score. An empty table stays empty.
    """
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows, all columns, of the least doc_id of each group of near duplicates.

    Of rows that repeat a doc_id the one of the least SHA-256 of its values
    stays, in whatever order they come; rows with a null doc_id all stay, and so
    does every document without words.
    """
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows, all columns, of which less than one word in twenty lies within a window of ``benchmark``.

    Null and empty texts stay; repeated rows are judged each by itself.
    """
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with secrets in ``text`` replaced; ``n_chars`` follows the new text. Null texts stay as they are."""
    clean = secrets.redact_secrets(docs)
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every row, and no other column. A null text has no tokens."""
    out = bpe.encoded(docs, vocabulary())
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and what a stage wrote for itself then goes."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with swept(spark, name):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
