"""From raw documents to token ids: rules, line dedup, near-duplicates, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`. A stage's result is written to the shared folder and read back
as the next one's input, so a lost executor repeats one stage's tasks at most.

Defined cases, of any stage: null and empty texts have no words, so the first stage rejects them; the
others would pass them on, but for the mix, which gives them no row; a text of any length is judged
whole; rows that repeat a doc_id are rows of their own until the third stage, which keeps all rows of the doc_id
that stays; of rows without doc_id and with like texts one stays; an empty table gives no rows; columns beside
those of `documents` are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import byte_bpe, line_dedup, mixing, ngram_join, quality_rules
from vectorloom.llm.common import materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and so do documents that are rejected."""
    return quality_rules.clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    return line_dedup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8 or more, one stays."""
    return ngram_join.keep_representatives(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: rows are repeated, or cut to their chosen blocks."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (32-bit little-endian) of each row of the mix, and digests of ids and decoded text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "bpe_ids",
        F.floor(F.octet_length("bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2("bpe_bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]

# The seeded block selection of the mix and the merges of the encoding are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
