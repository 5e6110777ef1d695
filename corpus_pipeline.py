"""A corpus pipeline of five stages: identify languages, drop copies and near copies, mix, encode.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet to the shared workspace
and read again as the next stage's ``docs``; the stages before the last return the columns of ``documents``.

Stages decide on keys: a row's file and its place there. They write keys, hashes and signatures, which go when the
stage has decided, and take documents from where they stand. ``run`` deletes a stage's documents once the next has its own.

Defined in every stage: an empty table gives an empty result; texts are read whole, however long; columns that a stage doesn't need
are carried along, whatever their names; rows that repeat a ``doc_id``, or have none, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language_id, mixing, near_dedup, sentence_pieces
from tessera.llm._common import forget, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text whose language can be told go: null and empty texts, and those without a letter.

    Where no row has a text and a language to learn from, no language can be told and all documents go.
    """
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays; one without an id only where all are. Of rows equal in both, one stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their sets of word 5-grams, the one with the smallest id stays.

    A pair at 0.8 shares none of 64 bands of 7 minima with probability 3e-7. Texts without words are linked with nothing and stay; one
    without an id is first only where all of its group are. Of rows equal in text and id, one stays.
    """
    return near_dedup.drop_near_copies(docs, percent=80, bands=64)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mixture takes them, up to three times; those it doesn't take go, and those without words.

    A null source is a source like others, after them.
    """
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids, spans and decoded texts, a row for each document of the mixture.

    Digests are written here, so that texts go to Python in batches of bounded size. A null text counts as empty: begin and end ids alone.
    """
    model = sentence_pieces.model_bytes(spark, sentence_pieces.public_model())
    return materialize(sentence_pieces.digests(sentence_pieces.encode(docs, model, spans=False, tokens=False), "doc_id"), "pieces")


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: Automata, signatures and merges have no form in SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if written is not None:
            forget(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
