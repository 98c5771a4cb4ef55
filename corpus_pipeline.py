"""A training corpus from `documents`: quality rules, SimHash near-dedup, substring dedup, packing.

Each stage takes and, but for the last, returns the columns of documents. A document that the quality rules
reject goes; of each group of near-duplicates the one with the smallest id stays; passages of 35 words or
more that recur are cut out of what is left, and a document that has nothing left stays as an empty text;
the last stage packs all texts into sequences.

Defined cases: a null or empty text fails the quality rules; where it comes to a later stage all the same, it
is a copy of every other text without words, has no passages, and is packed as the end id alone. Of rows that
repeat in full one stays. A row without an id stays only if its group has no other. Columns beside those of
documents are kept up to packing, whatever their names. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from lodestone.llm.common import cut, table
from lodestone.llm.packing import pack
from lodestone.llm.passages import remove_passages
from lodestone.llm.quality import accepted
from lodestone.llm.similar import without_similar
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_similar(docs, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]
#: Fingerprints, automata and packing are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
