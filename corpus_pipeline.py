"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``:

1. toxicity         documents that the grammar rejects go;
2. exact_dedup      of equal texts the lowest id stays;
3. near_dedup       one document of each SimHash group stays;
4. source_mix       blocks are apportioned to sources by tempered weights;
5. sentencepiece    token ids of every document that is left.

Defined results: documents of null or empty text aren't toxic; null texts and
null ids are no copies and stay, empty texts are copies of each other; of
repeated rows one stays; null texts count no tokens and go with the block that
they fall in, a null source is a source of its own; a text of any length is
taken whole; an empty table gives empty tables.  Columns beyond those of
``documents``, whatever their names, are carried through all stages but the
last; the last ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewright.llm import exact_dedup as exact, mixing, registry, sentencepiece as pieces, simhash, toxicity as toxic
from lorewright.llm._store import drop_written, mark, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.drop_toxic(docs, toxic.fit(docs, registry.labels(spark, sf_dir)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: The grammar, SimHash and the encoder can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage needed besides is dropped after it."""
    docs, since = registry.table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, since, keep=docs)
    return docs
