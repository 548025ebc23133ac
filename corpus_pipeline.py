"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
stage's docs. Each works on all that its predecessor kept, and trains or counts on that alone.

Defined results: null and empty texts and texts without letters go with the first stage, as do all rows of an empty
table or one without a known language; of equal texts the largest doc_id stays (a null one only without others), of near
copies the smallest; rows that repeat doc_id and text stay or go together, other rows that share a doc_id are separate
documents; the mix repeats rows or leaves them out; extra columns and clashing names pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavecrate.llm.common import materialise, release, scratch_mark, table
from wavecrate.llm.exact_dedup import exact_dedup
from wavecrate.llm.language import in_known_language
from wavecrate.llm.mixing import mixed_documents
from wavecrate.llm.near_dedup import near_dedup
from wavecrate.llm.pieces import encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    return in_known_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest doc_id of equal texts."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their target weights."""
    return mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, a row for each document of the mix."""
    return encode(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learned, probabilistic and tokenizer stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, f"stage-{name}")  # the stage's own tables and its input
    return STAGES[-1][1](spark, docs, sf_dir)
