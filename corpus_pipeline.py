"""From raw documents to packed sequences: each stage is one training-data operator over all that the last one kept.

Quality rules reject documents; of each group of near copies (five-word shingles, similarity 0.8) one document stays;
secrets are replaced by their kind; sources are mixed to target weights, so a document may come twice and the one at
which a source's budget ends is cut; what is left is packed into sequences of 4096 tokens. All but the last stage
return the columns of `documents`. Null and empty texts, repeated rows and empty tables are treated as the operators'
docstrings say: a null text fails the quality rules, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, near_dedup, packing, quality_rules, secret_scan, source_mix

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_quality(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", keep_quality),
    ("near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: MinHash, hashed sampling and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows. What the stages save is deleted once the next stage has read it; the tables behind the result
    stay until `common.release`."""
    docs = common.documents(spark, sf_dir)
    with common.scratch(spark):
        for name, stage in STAGES[:-1]:
            with common.scratch(spark):
                docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", lasting=True)
        with common.unscoped():
            return STAGES[-1][1](spark, docs, sf_dir)
