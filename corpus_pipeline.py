"""A training corpus from raw documents in five stages; a part of the `llm` subpackage.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a
DataFrame; all but the last return the columns of documents. Label and benchmark tables are read
from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallspark.llm import decontamination, minhash, packing, quality, toxicity
from recallspark.llm.common import scratch, table, written
from recallspark.llm.encoding import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that operator 8 predicts toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that operator 2 predicts to be of low quality."""
    return quality.without_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of operator 10."""
    return minhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents into which a benchmark item leaks, by operator 3."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and sequences of operator 4."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: Learnt models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    *first, (last_name, last) = STAGES
    with scratch(spark):  # what operators and stages have written goes, but for the last result
        for name, stage in first:
            with scratch(spark):
                docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        return written(last(spark, docs, sf_dir), last_name, keep=True)
