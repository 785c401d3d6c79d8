"""The corpus pipeline: documents in, shards of a clean, mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.llm import decontaminate, langid, minhash, mixing, sharding
from oscilla.llm.store import new_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents go that have no letter or that the network can't tell from a guess; all others stay as they are.

    The network decides: its best language must reach ``langid.LEAST`` times the probability of a guess among the
    languages it learned. Where there is none to learn, documents with a letter stay.
    """
    return langid.drop_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near-duplicates the document with the least id stays."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to the production weights: four fifths of the tokens, each document once at most, the last of a leaf cut to its prefix."""
    return mixing.mixed_documents(docs, domain=F.expr(mixing.DOMAIN), weights=mixing.WEIGHTS, budget_percent=80, max_epochs=1)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the columns of documents with their shard, its documents and its bytes."""
    return sharding.sharded(docs, F.expr(sharding.ARRIVAL))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: The language stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents of ``sf_dir``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
