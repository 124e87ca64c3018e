"""From raw documents to training shards, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet to the shared
folder and read again as the next one's docs. All but the last return the columns of documents.

1. quality: documents that the weak-label classifier rejects go.
2. near_duplicates: of documents whose word 5-grams have a Jaccard similarity of 0.8 or more (and of chains
   of these) one stays.
3. decontamination: documents of whose words a twentieth or more is benchmark text go.
4. mixing: sources are mixed to their target weights; a document is taken up to three times, or not at all.
5. sharding: a reproducible shuffle over 40 shards; adds size, text_crc32, law, shard and slot.

Edge cases, stage by stage: null and empty texts are kept by 1, 2 and 3 (no words, no shingles, no benchmark words) and not
taken by 4 (no words); repeated rows are judged alike by 1 and 3, one of them stays in 2, and 4 takes them alike; texts of any
length are read whole by every stage; of equal near duplicates the smallest id stays, a null id last; an empty table gives an
empty one; extra columns pass through all stages, but for those that 5 adds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, mixing, ngram_join, quality, sharding
from plumbline.llm.registry import table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs.withColumns(sharding.measures()))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The classifier and the random draws are beyond SQL; tests/llm hold every stage against brute force.
ORACLE_SQL = None


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors share; a temporary one for a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="plumbline-")
    return f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
