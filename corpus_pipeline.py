"""The corpus pipeline: what a document goes through on its way into a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes
it as Parquet and reads it again as the next stage's documents.  All stages but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relafix.llm import jaccard, mixing, pieces, pii, quality
from relafix.llm.queries import PIECE_MODEL
from relafix.storage import stage_table
from relafix.tables import table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.reject_low_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity of 0.8 or more."""
    return jaccard.drop_near_duplicates(docs, n=5, num=80, den=100)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced."""
    return pii.sanitise(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids."""
    return pieces.encode_texts(docs, PIECE_MODEL)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", remove_personal_data),
    ("mixing sources to target weights", mix_to_targets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier, the shingle hashes, the random order and the pieces are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"stage{i}")
    return docs
