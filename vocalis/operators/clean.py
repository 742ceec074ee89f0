"""The cleaning chain: raw text to tokens, bigrams, topics and flags."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.functions import text as T
from vocalis.functions.rows import is_leadership, recode_label
from vocalis.operators.tagging import binarize_topics, tag_topics
from vocalis.session import BROADCAST_ROWS, LITERAL_ROWS, LOOKUP_BYTES, LOOKUP_TIMES, broadcast_if_small, has_at_most, materialize, with_row_id

# A dictionary of at most LITERAL_ROWS rows and so many bytes becomes a literal of an expression.
LITERAL_BYTES = 1 << 20
# The literal is split by the hash of the token, since a map is searched from its start.
LITERAL_PARTS = 256


def clean_tokens(
    df: DataFrame,
    text: str = "text",
    name: str = "tokens",
    strip_handles: bool = False,
    hashtags: str | None = None,
    select_tags: Sequence[str] = (),
    lemmas: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Punctuation, URLs, tokens, hashtags, lemmas, stop words - in this order.

    Without a lemma dictionary the chain is one narrow stage.
    """
    plain = T.strip_urls(T.strip_punctuation(F.col(text)))
    if strip_handles:
        plain = T.strip_handles(plain)
    tokens = T.strip_hashtags(T.tokenize(plain), hashtags, select_tags)
    if lemmas is None:
        return T.with_once(df, **{name: T.remove_stopwords(tokens)})
    raw = T.with_once(df, **{name: tokens})
    lemmatized = lemmatize(raw, name, lemmas, tags)
    return T.with_once(lemmatized, **{name: T.remove_stopwords(F.col(name))})


def token_lemmas(lemmas: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """``token, lemma`` of every token that changes: the two dictionaries joined once, since the
    tag of a token does not depend on its text."""
    forms = lemmas.groupBy("token", "pos").agg(F.min("lemma").alias("lemma"))
    if tags is None:
        chosen = forms.where(F.col("pos") == "n")
    else:
        tag = tags.groupBy("token").agg(F.min("pos").alias("_tag"))
        chosen = forms.join(tag, "token", "left").where(F.col("pos") == F.coalesce("_tag", F.lit("n")))
    return chosen.where(F.col("lemma") != F.col("token")).select("token", "lemma")


def _literal_lemmas(forms: DataFrame):
    """Lemma of a token as an expression over a literal dictionary, NULL for other tokens."""
    part = F.pmod(F.xxhash64("token"), F.lit(LITERAL_PARTS)).cast("int").alias("part")
    parts: list[list[str]] = [[] for _ in range(LITERAL_PARTS)]
    for r in forms.select("token", "lemma", part).collect():
        parts[r["part"]].append(f"{r['token']}\x01{r['lemma']}")
    maps = F.array(*[F.str_to_map(F.lit("\x02".join(p)), F.lit("\x02"), F.lit("\x01")) for p in parts])
    return lambda t: F.try_element_at(F.get(maps, F.pmod(F.xxhash64(t), F.lit(LITERAL_PARTS)).cast("int")), t)


def _shared_lemmas(forms: DataFrame):
    """Tokens by their lemmas as a function over whole columns; the dictionary, whose size was
    checked, lies once in every Python worker."""
    table = forms.select("token", "lemma").toArrow()
    shared = forms.sparkSession.sparkContext.broadcast((table["token"].combine_chunks(), table["lemma"].combine_chunks()))

    @F.arrow_udf("array<string>")
    def lemmas_of(lists: pa.Array) -> pa.Array:
        known, lemma = shared.value
        flat = lists.flatten()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        kept = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])
        found = pc.coalesce(lemma.cast(flat.type).take(pc.index_in(flat, value_set=known.cast(flat.type))), flat).drop_null()
        offsets = kept[np.concatenate([[0], ends]).astype(np.int64)]
        return type(lists).from_arrays(pa.array(offsets, pa.int64() if pa.types.is_large_list(lists.type) else pa.int32()), found)

    return lemmas_of


def lemmatize(df: DataFrame, tokens: str, lemmas: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Replace each token by its lemma, row by row; ids may repeat or be NULL.

    ``lemmas(token, pos, lemma)`` and ``tags(token, pos)`` are dictionaries.  A token without
    a tag counts as a noun (``n``), one without a lemma stays; NULL tokens give an empty list.
    Dictionaries whose changing tokens are few (counted) become a literal of a narrow expression,
    larger ones that a task can hold are looked up by column in Python workers, so nothing is
    shuffled; for still larger ones the rows are numbered and placed by their number first, so
    that the tokens are put back together without moving again.
    """
    forms = materialize(token_lemmas(lemmas, tags))
    plain = forms.where(~F.col("token").rlike("[\x01\x02]") & ~F.col("lemma").rlike("[\x01\x02]"))
    if has_at_most(forms, LITERAL_ROWS, LITERAL_BYTES) and plain.count() == forms.count():
        lemma = _literal_lemmas(forms)
        kept = F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: t.isNotNull())
        found = F.transform(kept, lambda t: F.coalesce(lemma(t), t)).alias(tokens)
        return df.select(*[found if c == tokens else F.col(f"`{c}`") for c in df.columns])
    if has_at_most(forms, LOOKUP_TIMES * BROADCAST_ROWS, LOOKUP_BYTES):
        found = _shared_lemmas(forms)(F.col(f"`{tokens}`")).alias(tokens)
        return df.select(*[found if c == tokens else F.col(f"`{c}`") for c in df.columns])
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != tokens], F.lit(1).alias("_one"))
    placed = with_row_id(df.select(F.col(tokens).alias("_tokens"), rest.alias("_rest"))).repartition(F.col("_row"))
    rows = placed.select("_row", "_rest", F.posexplode_outer("_tokens").alias("_pos", "_token"))
    # The other columns travel on the first token only.
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    rows = rows.withColumn("_rest", F.when(first, F.col("_rest")))
    forms = forms.withColumnsRenamed({"token": "_token", "lemma": "_lemma"})
    rows = rows.join(broadcast_if_small(forms), "_token", "left")
    placed_tokens = F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_lemma", "_token").alias("t"))))
    out = rows.groupBy("_row").agg(
        F.filter(F.transform(placed_tokens, lambda x: x["t"]), lambda t: t.isNotNull()).alias("_tokens"),
        F.first("_rest", ignorenulls=True).alias("_rest"),
    )
    return out.select(*[F.col("_tokens" if c == tokens else f"_rest.`{c}`").alias(c) for c in df.columns])


def clean_documents(
    df: DataFrame,
    lexicon: DataFrame,
    topics: Sequence[str],
    text: str = "text",
    source: str | None = None,
    leadership_sources: Sequence[str] = (),
    labelled: bool = False,
    strip_handles: bool = False,
    hashtags: str | None = None,
    select_tags: Sequence[str] = (),
    lemmas: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """The whole chain, ending in one flag per topic of the fixed list ``topics``.

    Posts without tokens, and unlabelled posts without any lexicon bigram, are dropped.
    """
    out = clean_tokens(df, text, "tokens", strip_handles, hashtags, select_tags, lemmas, tags)
    out = out.where(F.size("tokens") > 0)
    if "label" in out.columns:
        out = out.withColumn("label", recode_label(F.col("label")))
    words = T.strip_hashtags(F.col("tokens"), "all")
    out = T.with_once(out, _words=words)
    out = T.with_once(out, _grams=T.tokens_plus_bigrams(F.col("_words"))).drop("_words")
    out = tag_topics(out, "_grams", lexicon)
    if not labelled:
        out = out.where(F.size("topics") > 0)
    led = is_leadership(F.col(source), leadership_sources) if source else F.lit(False)
    return binarize_topics(out.drop("_grams").withColumn("leadership", led), topics).drop("topics")
