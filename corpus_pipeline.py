"""A corpus from raw documents to packed sequences, a stage at a time."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, near_dup, packing, pii, quality
from tessella.llm.store import keep, sized, table


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is none of the rejected ones; a null id never is."""
    ids = keep(rejected.select("doc_id").where("doc_id is not null").distinct(), "rejected")
    return docs.join(sized(ids), "doc_id", "left_anti").select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by itself; of an empty table none, and a null text goes."""
    return quality.kept_rows(docs, quality.trusted(table(spark, sf_dir, "labels")))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; of rows that share id and text, one."""
    found = keep(near_dup.near_duplicates(docs), "near_dup")
    out = _without(docs, found.where("not kept"))
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; a null text stays, and rows without an id stay.  An id goes with all its rows."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their identifiers replaced; ``n_chars`` is that of the new text.  Null texts stay null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences and their ids; a null or empty text is one piece, and equal rows have one each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good),
    ("near_dup", unlike),
    ("decontamination", uncontaminated),
    ("pii", redacted),
    ("packing", packed),
]

#: Near duplicates, ratios of a hashed model and best fit have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
