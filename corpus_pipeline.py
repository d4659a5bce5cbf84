"""A training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept and returns a
DataFrame, which is written and read again as the next stage's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editpulse.llm.bpe import encode_decode
from editpulse.llm.decontaminate import find_leaks
from editpulse.llm.line_dedup import drop_common_lines
from editpulse.llm.near_dups import survivors
from editpulse.llm.quality_rules import MIN_WORDS, judge
from editpulse.sources.staging import stage

#: A word as the quality rules count it, and the shingle of the near-duplicate stage.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts go; a null language or source is a group of its own; equal texts of one
    group have equal verdicts, repeated rows all stay or all go. An empty table has an empty result.
    """
    return judge(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more hold; ``n_chars`` follows a changed text.

    A document that lost lines and has too few words left for the quality rules goes; one that lost
    none stays as it is. A null or empty text is one empty line, which is never dropped. A line stays
    in the document of the largest doc_id; rows of one id are one document, and a row without id
    counts as none and loses every common line. An empty table has an empty result.
    """
    kept = drop_common_lines(docs)
    changed = F.col("n_dropped") > 0
    kept = kept.where(~changed | (F.regexp_count("kept_text", F.lit(WORD)) >= MIN_WORDS))
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        counted = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, counted).otherwise(F.col("row.n_chars"))
    return kept.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by shingles of five words; see ``survivors``."""
    return survivors(docs, shingle=SHINGLE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window.

    Null and empty texts hold none and stay, repeated rows share a verdict, and an empty table or
    benchmark drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark).where("n_hit = 0").select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; null is read as empty text.

    Repeated rows and rows without doc_id are coded each; an empty table has an empty result.
    """
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.coalesce("row.text", F.lit(""))
    return coded.select(
        "row.doc_id", "row.lang", "row.source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == text.cast("binary")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Robust estimates and byte-pair merges are no SQL; tests compare the stages with plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
