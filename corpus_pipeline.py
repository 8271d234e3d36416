"""The corpus pipeline: every stage applies one operator to all that the stage before kept.

Null and empty texts, repeated rows and ids, and tables without rows are rows like others, as
each operator's docstring says: null and empty texts are not toxic unless the labels say so, are copies of
each other, have no words to mix and so leave with the mix. All columns are passed on, whatever
their names, but names that start with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact, jaccard, mixing, packing, simhash, toxicity
from loomgraph.llm.common import FILE, ROW, bitmaps, located, marked_rows, stage, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on the labels scores below one half stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(docs, toxicity.learn(docs, labels))
    return docs.where(score("text") < 0.5)


def _without(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that ``judge`` keeps. The others are marked in bitmaps, so no text is shuffled.

    A frame that is no plain Parquet scan is stored first: both passes then meet the same rows.
    """
    docs = stored(docs)
    judged = judge(docs)
    rows = located(docs, *docs.columns)
    return marked_rows(rows, bitmaps(judged.where("not kept").select(FILE, ROW)), marked=False).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to blanks, the row with the smallest doc_id stays."""
    return _without(docs, exact.exact_dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 over five words, the row with the smallest doc_id stays.

    Fingerprints link texts first, the exact similarity decides on these links and adds those that
    fingerprints three bits apart miss.
    """
    return _without(docs, lambda rows: jaccard.near_copies(rows, simhash.near_duplicates(rows)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by fingerprints at most three bits apart, as in ``drop_near_copies``, or by way of both, the
    row with the smallest doc_id stays: every link of either operator holds.
    """

    def judge(rows: DataFrame) -> DataFrame:
        near = simhash.near_duplicates(rows)
        return jaccard.united(jaccard.near_copies(rows, near), near)

    return _without(docs, judge)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their places; repeated documents are packed each."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed shingles, a trained model and a tokenizer are not expressible; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
