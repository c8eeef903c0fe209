"""Documents to token files: toxic ones go, one of each near-duplicate group stays, benchmark
passages go, sources are mixed to target weights, and what is left is written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
into the shared folder as Parquet and reads it again as the next stage's ``docs``. All but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foretime.llm import decontamination, minhash, mixing, token_store, toxicity
from foretime.llm.common import stored
from foretime.session import pin


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on the labels, calls toxic."""
    return toxicity.rejected(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similarity 0.8 or more: that of the smallest id."""
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 3 : 1 : 2 over one and a half times the words; a document may come twice."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its place, length and checksum in the token files."""
    return token_store.digests(token_store.read_tokens(*token_store.write_tokens(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: The fitted model and the tokenizer are beyond SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pin(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
