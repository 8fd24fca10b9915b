"""The document operators as queries over the tables of one folder: each a thin call of its operator."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, decontaminate, divergence, frames, language, neardup, ngram_join, pii, quality, secrets, substrings, toxicity
from .common import crc_mod_col, table
from .oracles import ORACLES as ORACLES


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-level BPE file."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdicts of every document, with cutoffs from the labels."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that start in an earlier one."""
    return substrings.dedup(table(spark, sf_dir, "documents"), width=50, digest=True)


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a class-based model of those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod_col("doc_id", 7) == 2, F.lit(True)))
    return brown.learn_and_score(docs).withColumn("held_out", F.coalesce(crc_mod_col("doc_id", 7) == 2, F.lit(True)))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.85 or more."""
    return neardup.cluster(table(spark, sf_dir, "documents"), size=3, similarity=Fraction(85, 100))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod_col("doc_id", 4) != 2))
    return toxicity.predict(docs, model).select("doc_id", (crc_mod_col("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "evidence")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses under pseudonyms."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="example key").drop("lang", "source", "n_chars")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.filter(crc_mod_col("doc_id", 3) != 1))
    return found.select("doc_id", (crc_mod_col("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("score"), "rejected")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source differ from those of the other sources of its language."""
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed for filling in its middle, and rebuilt."""
    return frames.digests(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.join(table(spark, sf_dir, "documents"), size=3, similarity=Fraction(9, 10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_brown": op4_brown,
    "op5_neardup": op5_neardup,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "op11_divergence": op11_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ngram_join": op13_ngram_join,
}
