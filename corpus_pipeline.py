"""A training-data pipeline from the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's ``docs``. All but the last keep the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costgrain.llm import minhash, mixing, packing, quality, simhash, toxicity
from costgrain.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality ranking rejects go. Null and empty texts are ranked like any other, repeated
    rows alike; without labels of both kinds nothing is rejected; an empty table stays one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents predicted toxic go. Null texts count as empty; without labels of both kinds none is predicted
    toxic; texts are scored whole, however long."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near-duplicates stays, the one with the smallest doc_id: groups are of texts
    whose fingerprints are within four bits, or whose shingles of five words are alike by 0.8 or more (fingerprints of operator
    10). Blank texts are one group; of rows that repeat a doc_id one stays; rows without one all stay."""
    return simhash.keep_first(docs, minhash.alike)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the stretches of documents that the mix takes, repeats included. Texts without words take no part;
    a null source is a source; reruns take the same."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: length bucket, batch and slot of every stretch; ties go by the order of the row's columns."""
    return packing.pack(docs)


STAGES = [("good_quality", good_quality), ("not_toxic", not_toxic), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Models, hashes and permutations decide the stages; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each cut off from the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
