"""The corpus pipeline: five stages, each over all that the one before kept.

Toxic documents go, exact copies go, one document of each group of near copies stays, sources
are repeated to their target weights, and what is left is encoded by byte-level BPE and decoded
again. All stages but the last return the columns of ``documents``, whatever their names.

Defined results: a null text is an empty one, which scores as no evidence, is a copy of other
texts without a character, has no shingles and no tokens; null doc_ids and sources are values
like any other; of rows that repeat in full, share a doc_id or have none, one of each group
stays, as of rows apart; very long texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import bpe, exact_dedup, minhash, mixing, toxicity
from ledgerweave.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on ``labels``, does not reject."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return minhash.one_of_each_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, repeats included."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("poisson mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage is a trained machine, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the session's shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut_lineage(spark.range(1))  # sets the shared folder where the session has not used it yet
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
