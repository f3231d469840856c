"""The corpus pipeline: five stages over `documents`, each written and read again.

Toxic documents go, then documents that fail the quality rules (those that stay
lose their failing lines), then all but the first of near-duplicates; the rest is
mixed to the source weights, a document as often as it is taken, and encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm import byte_bpe, mixing, quality_lines, simhash, toxicity
from specforge.llm.common import fresh, stored, table

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold.

    Labels are joined to the stage's own documents.  Null and empty texts stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, with the lines that pass."""
    return quality_lines.keep(docs, n_chars="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of close fingerprints."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the text, and digests of ids and decoded bytes."""
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            ["doc_id", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]

# A fitted model, a seeded hash and a tokenizer are among the stages, which SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
