"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again for the
next. All but the last return the columns of ``documents``, and any further ones
that their input has.

Null and wordless texts fail the first stage's rules. Repeated rows, and
documents that share a doc_id, each count by their text; of near duplicates one
row stays. A null source is a source. Very long texts go through whole, but for
the mix, which cuts where a budget ends. Empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm import mixing, near, packing, pii, quality
from obsflow.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy ``v1`` keeps (operator 4)."""
    return quality.keep_passing(docs, "v1")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id (operator 6)."""
    return near.keep_one(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind (operator 9)."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or cut as the mix takes them (operator 3)."""
    return mixing.take_words(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences (operator 1), with their token ids."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("personal data", personal_data),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: Near duplicates, the span classifier and the tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        out = step(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/obsflow/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
