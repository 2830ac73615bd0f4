"""A training-data pipeline over ``documents``: five stages, each over all rows that the one before kept.

Defined results, in every stage: a null text counts as empty; rows that repeat are rows of their own; other columns come back as they are, also ones named like a
column that a stage works with; an empty table gives an empty one. Each stage says what null ids and ties do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackleaf.llm import line_dedup, mixing, piece_lattice, quality, simhash
from stackleaf.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.3 go. A score depends on the text alone, so equal texts stay or go together; rows without an id are
    scored like others but can't be labelled; without labels of both kinds all have one score."""
    labels = table(spark, sf_dir, "labels").where(quality.held_out(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, quality.fit(quality.measure(docs), labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but in the smallest doc_id; n_chars follows the text. Documents stay, with an empty text if all their lines go; rows that repeat an id lose
    lines alike; rows without an id neither make a line repeated nor lose any."""
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component (shingles of five words: fingerprints within 3 bits, or sets of a Jaccard similarity of 0.8) the smallest doc_id stays.
    Rows that repeat this id all stay, as do rows without an id; texts without words have the fingerprint 0 and are copies of each other."""
    return simhash.keep_first(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most. A null source is a source; a source without words gives nothing; rows alike in size and id
    are taken in the order they are read."""
    return mixing.emit(mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, which decode to its text; an empty text has none. Rows that repeat id and text get the same pieces; a null id is a key
    of its own."""
    return piece_lattice.encode(docs).select(F.col("id").alias("doc_id"), "n_bytes", F.size("ids").cast("long").alias("n_pieces"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The classifier, the fingerprints and the sampled pieces have no SQL form; tests/llm/test_stages.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
