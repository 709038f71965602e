"""A training corpus from the documents table, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Edge cases, in every stage: null, empty and very long texts, repeated rows and ties are treated as the stage's
operator says; an empty table gives an empty result; columns beyond those of documents are dropped, whatever
their names. A null or letterless text goes in the first stage, since it has no language.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import decontaminate, language, mixing, near_dedup, packing
from gridlore.llm.common import cut, load, release, total_bytes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Octets of text that an output shard of the mix holds, about.
SHARD_BYTES = 32 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words the learnt languages explain stay; those without a letter, and those of which over half of
    the words are better explained by chance, go."""
    found = language.identify(docs, language.learn(language.learnt_from(docs)))
    return found.where(F.col(found.columns[-1])["known"]).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id stays."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix draws, shard by shard in the shard's order."""
    levels = max(mixing.LEVELS, math.ceil(math.log2(max(1, total_bytes(docs)) * 1.5 / SHARD_BYTES)))
    drawn = mixing.mix_sources(docs, levels=levels, cell_bits=max(mixing.CELL_BITS, levels), carry=("text", "lang", "n_chars"))
    copies = drawn.select(*COLUMNS, F.explode("draws").alias("_draw"))
    return copies.repartition(F.col("_draw.shard")).sortWithinPartitions("_draw.shard", "_draw.order_key").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("pack", packed),
]

#: No stage but the filters can be told in SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
