"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import stored
from lodestrand.llm.line_dedup import drop_shared_lines
from lodestrand.llm.near_copies import keep_one_near
from lodestrand.llm.packing import digest, pack
from lodestrand.llm.secrets import redact
from lodestrand.llm.toxicity import drop_toxic, fit, held_out


def _like(rewritten: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; the length column follows the rewritten text."""
    return rewritten.select(*(F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go.

    Null and empty texts stay; repeated rows stay or go together; no rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return drop_toxic(docs, fit(docs, labels.where(~held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; every document stays.

    A null text becomes the empty text; no rows give no rows.
    """
    return _like(drop_shared_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard 0.8 or more), the document with the smallest id stays.

    Operator 2's trie walk, in buckets: see ``near_copies``. Texts that are null or have no
    words are one group; repeated rows become one; a null id stays only where its group
    has no other.
    """
    return keep_one_near(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; every document stays, repeated rows too.

    A null text stays null; no rows give no rows.
    """
    return _like(redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end mark alone. No rows give no pieces."""
    return digest(pack(docs))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: The toxicity model is fitted by steps that SQL cannot express; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
