"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from editpulse.llm import oracles, toxicity
from editpulse.llm.bpe import encode_decode
from editpulse.llm.collocations import mine_collocations
from editpulse.llm.decontaminate import find_leaks
from editpulse.llm.line_dedup import drop_common_lines
from editpulse.llm.lm_scoring import score_texts
from editpulse.llm.near_dups import near_duplicates
from editpulse.llm.periodic_runs import collapse_runs
from editpulse.llm.pii import KINDS, find_personal_data
from editpulse.llm.quality_classifier import THRESHOLD, held_out, score_quality
from editpulse.llm.quality_rules import COUNTS, judge
from editpulse.llm.secret_scan import BASE_KINDS, find_secrets
from editpulse.llm.warc_revisits import captures_of_pages, resolve_revisits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document against all others."""
    scored = score_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    return scored.select("row.doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def _joined(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _counted(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    return [F.expr(f"cast(size(filter({spans}, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in kinds]


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data and all spans that the trees select, for every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", *_counted("base", KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and survivor of every document; four words a shingle, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, response, payload digest and merged header fields of every capture derived from the pages."""
    resolved = resolve_revisits(captures_of_pages(table(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform("fields", lambda h: F.concat_ws("=", h["name"], h["value"])), ";")
    return resolved.select("record_id", "canonical_url", "outcome", "response_id", "payload_sha256", fields.alias("fields"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to."""
    coded = encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], packed=True
    )
    return coded.select(
        "row.doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of every document that benchmark windows of ten words hit."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after dropping those that three or more documents share."""
    kept = drop_common_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of secrets and all spans kept after counting owners, for every document."""
    found = find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    verdicts = [F.expr(f"cast(size(filter(spans, s -> s.verdict = '{v}')) as long)").alias(f"n_{v}") for v in ("live", "example", "weak")]
    return found.select("row.doc_id", *_counted("base", BASE_KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), *verdicts)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from labels outside the held-out fifth."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether base rules and robust distance keep it."""
    judged = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", *COUNTS, "base_failed", "kept", "distance")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from labels outside the held-out third."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("row.doc_id", "score")
    toxic = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", toxic.alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of each language."""
    return mine_collocations(table(spark, sf_dir, "documents"))


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text; in the texts whose id's crc32 ends in 0, the words from a place on repeat one stretch.

    With h the crc32 of the id in decimals and g = h div 10, the words from a = g mod n on become
    those of the first p = 1 + (n - a) div (3 + g mod 8) of them, over and over.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = F.expr("if(h % 10 = 0, regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0), NULL)")
    spoken = documents.select("doc_id", "text", h.alias("h")).withColumn("words", cut)
    sized = spoken.withColumn("n", F.coalesce(F.array_size("words"), F.lit(0))).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    again = "array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8))) as int)]), ' ')"
    return sized.select("doc_id", F.when(F.col("n") > 0, F.expr(again)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, its longest one, and digests of all runs and of the collapsed text."""
    found = collapse_runs(with_planted_periods(table(spark, sf_dir, "documents")), ["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    named = found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
    named = named.select("*", F.expr("-best.col2").alias("start"), F.col("best.length").alias("length"), F.expr("-best.col3").alias("period"))
    return named.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_pii": op2_pii,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = oracles.STATEMENTS
