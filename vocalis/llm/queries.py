"""One query per operator over its whole table, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm import bpe, decontam, html_blocks, lm, periodic, quality, ranked_search, secret_scan, shards, simhash, token_trees, toxic_spans, urls
from vocalis.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op7_rendezvous_shards(spark, d):
    """Every document in one of 24 shards by its id."""
    return shards.shard_records(table(spark, d, "documents"))


@query
def op1_markov_secrets(spark, d):
    """Secrets of every document by pattern and by character chains."""
    docs = table(spark, d, "documents")
    return secret_scan.secret_report(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


@query
def op5_divergence_quality(spark, d):
    """Measures and verdict of every document."""
    docs = table(spark, d, "documents")
    return quality.quality_report(docs, quality.fit_references(docs, table(spark, d, "labels")))


@query
def op6_bpe_tokens(spark, d):
    """Ids of every document by the public ranks, and their decoded bytes."""
    return bpe.token_digests(table(spark, d, "documents"))


@query
def op4_url_filter(spark, d):
    """Verdict on every page's URL."""
    pages = table(spark, d, "pages")
    return urls.judge(pages, urls.train(urls.labelled_urls(pages)))


@query
def op10_benchmark_passages(spark, d):
    """Passages of test items in the documents."""
    return decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op2_simhash_components(spark, d):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op3_bilinear_scores(spark, d):
    """Unigram and log-bilinear log-probability of every document."""
    return lm.score(table(spark, d, "documents"))


@query
def op8_block_labeller(spark, d):
    """Main text of every page."""
    pages = table(spark, d, "pages")
    return html_blocks.extract(pages, html_blocks.train(html_blocks.sample_pages(pages)))


@query
def op9_edited_counts(spark, d):
    """Tokens of every document before and after its private strings are masked and its source is
    put in front."""
    docs = table(spark, d, "documents").select("doc_id", "text", token_trees.masking_edits(F.col("text"), F.col("source")).alias("edits"))
    return token_trees.edited_counts(docs)


@query
def op11_ranked_search(spark, d):
    """The best documents for every test item."""
    return ranked_search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


# DuckDB has no 64-bit overflow here: a sum of products is cast back from 128 bits.
ORACLE["op11_ranked_search"] = """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL
), whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM lengths
), asked AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, whole WHERE term IN (SELECT term FROM asked) GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), whole GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""


@query
def op12_toxic_spans(spark, d):
    """Chance that a document is toxic, from a field fitted to the labelled ones."""
    docs = table(spark, d, "documents")
    model = toxic_spans.fit(*toxic_spans.labelled_texts(docs, table(spark, d, "labels")))
    return toxic_spans.toxicity_report(toxic_spans.score(docs, model))


@query
def op13_periodic_runs(spark, d):
    """Periodic runs of every document, the tails of some repeated first."""
    return periodic.run_report(periodic.with_runs(table(spark, d, "documents"), words=periodic.looped))
