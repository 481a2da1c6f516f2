"""Registered queries of the corpus operators: ``opN_<name>`` and ``pipeline``.

Each reads its whole tables with production parameters and derives its
columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.llm import audit, fingerprints, lines, mixing, neardup, packing, quality, radix, repeats, rules, spelling, toxicity, warc
from odonto.llm.common import bound_batches, is_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of every document under the production policy."""
    ledger = rules.apply_policy(rules.measure(table(spark, sf_dir, "documents")))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_lines", "n_shouts", "fail_bits")


@register
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words every document gives to the mix of all documents."""
    t = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return t.select("doc_id", "size", "source_size", "target", "taken", "source")


@register
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path)


@register
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    read = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; remainder 2 of 4 is held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), is_remainder(F.col("doc_id"), 4, 2))


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; remainder 0 of 5 is held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), is_remainder(F.col("doc_id"), 5, 0))


@register
def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    docs = table(spark, sf_dir, "documents")
    return fingerprints.with_neighbours(docs, fingerprints.lexicon(docs))


@register
def op4_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document loses to repeats of 13 words or more."""
    return (repeats.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


@register
def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, at 85 % of shared shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses to equal or near earlier lines."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents"), equal_chars=lines.EQUAL_CHARS)
    return found.select("doc_id", "n_lines", "n_equal", "n_near", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document and the row that stays."""
    return radix.equal_texts(table(spark, sf_dir, "documents"))


@register
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of every order of the five filters removes, per language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word that documents hold five times or more."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))
