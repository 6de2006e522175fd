"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Defined cases, beyond those of each operator: a document is told from others by
its id; of rows that repeat a kept id with other texts near_duplicates keeps all
that are not near copies of an earlier id. A corpus without any label or text to learn
from has no language that can be named, so nothing is left of it.

Tables between stages lie below the folder that spark.checkpoint.dir names and stay
there, as the result may read them later; the caller clears that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import langid, lines, mixing, neardup, pieces
from sluice.llm.common import read_table, scratch_ready

#: Stages that SQL can't express (a trained tagger, a hash signature) decide the result.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the tagger can name go."""
    return langid.drop_unidentified(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words or more go; n_chars follows the text."""
    return lines.drop_repeated_lines(docs, length_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (5-word shingles, 0.8)."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix emits them."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each emitted document's ids, and whether they decode to its text."""
    return pieces.encode(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_neardup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between them in the folder
    that spark.checkpoint.dir names."""
    scratch_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs.select("doc_id", "n_pieces", "n_bytes_spelled", "score", F.lower("ids_sha256").alias("ids_sha256"), "decodes")
