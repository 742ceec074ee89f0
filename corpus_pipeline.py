"""A pipeline over ``documents``: quality rules, near-duplicates, benchmark passages, secrets,
tokens.

Every stage is ``f(spark, docs, sf_dir)`` over all its predecessor kept.  All but the last return
the columns of ``docs``; the last returns the tokens of every document that is left.  NULL texts
have no words and go with the first stage, and an empty table passes through; extra columns,
whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.functions.text import with_once
from vocalis.llm import bpe, decontam, quality, secret_scan, simhash
from vocalis.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the base rule and resemble a language reference."""
    refs = quality.fit_references(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    judged = quality.judge(whole, refs, "_text", "_lang")
    # Without the barrier the filter would hold a copy of the whole verdict.
    return with_once(judged.select("_doc", "kept"), kept=F.col("kept")).where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: fingerprints of four-word shingles that
    chains of at most four differing bits connect."""
    return simhash.one_of_each_group(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    chains = secret_scan.train(secret_scan.labelled_samples(docs))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    found = secret_scan.scan(whole, chains, "_text").select("_doc", secret_scan.mask("_text", F.col("spans")).alias("_masked"))
    changed = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"_doc.`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_tokens, decoded_sha256``."""
    done = bpe.with_tokens(docs.select("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL expresses neither fingerprints nor alignments; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
