"""A training corpus from raw documents: filter, deduplicate twice, mix sources, pack.

Every stage works on all that the one before kept; stages are written as Parquet and read again, so a lost
executor costs no more than the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talkweave.llm import exact, mixing, packing, resemblance, simhash, toxicity
from talkweave.llm.common import kept
from talkweave.llm.queries import number_digests, prepare

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    prepare(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, that of the largest id."""
    prepare(spark)
    return exact.drop_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates, that of the smallest id.

    Groups join over links of ``op6``'s fingerprints (4 or fewer differing bits) and, beyond their reach, of a five-word
    resemblance of 0.8 or more.
    """
    prepare(spark)
    return resemblance.drop_near_copies(docs, simhash_bits=simhash.MAX_BITS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    prepare(spark)
    return mixing.mixed_documents(docs, mixing.cyclic_weights([3, 1, 2]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``padded``."""
    prepare(spark)
    return number_digests(packing.pack_pieces(docs, TOKENIZER))


STAGES = [("toxicity", toxic), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("source_mix", source_mix), ("packing", packed)]

#: SQL can express neither the scores nor the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
