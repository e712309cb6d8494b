"""From raw documents to token shards: each stage takes the documents that the one before it kept, written and read again.

A stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserax.llm.common import held_out, materialise, table
from tesserax.llm.decontaminate import decontaminate
from tesserax.llm.language_id import fit, identified
from tesserax.llm.mixing import mixed_copies
from tesserax.llm.queries import byte_bpe
from tesserax.llm.simhash import one_of_each
from tesserax.llm.tokens import tokenize

#: Near copies here: a similarity of 0.8 or more over five-word shingles. Their fingerprints differ in about 10 bits then,
#: so besides the blocks' top nodes, where 3 bits may differ, bands of least hashes have nodes where 18 may.
NEAR = {"width": 5, "radius": 3, "blocks": 5, "bands": 16, "band_radius": 18}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: no letters, or no language ahead of the others. Held-out rows teach nothing."""
    return identified(docs, fit(docs.filter(~F.coalesce(held_out(), F.lit(False)))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row: that with the smallest doc_id, a null id last."""
    return one_of_each(docs, **NEAR)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that align with an item of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits documents as often as their source's target weight asks."""
    return mixed_copies(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns what they hold of each document."""
    return tokenize(docs, byte_bpe())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark_free),
    ("mixing", mixed),
    ("tokens", token_shards),
]

#: Compression sizes, fingerprints, alignment and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
