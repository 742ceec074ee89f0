"""Secrets in text: fixed patterns, and two Markov models of characters.

Base kinds: ``assign`` (a name of a secret, ``=`` or ``:``, a value of 12 or more characters),
``access`` (key ids), ``hex`` (16 or more digits).  The method adds kind ``markov``: runs of key
characters whose mean log-likelihood ratio between a chain trained on random strings and a chain
trained on ordinary identifiers exceeds a threshold.  All of it runs in column expressions.

Defined results: a NULL or empty text has no spans; spans are code points, end exclusive; equal
starts keep the order of kinds; repeated rows are scanned each; other columns are kept by
``scan`` unless they bear the name of a result, which then wins.  An empty table gives no rows
and a model from generated strings alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import let, smallest_ids

# --- fixed values: patterns of the base kinds -------------------------------------------
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the run has 18 or more characters; a shorter one fails from any start
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
# ----------------------------------------------------------------------------------------
#: Candidate runs of the method; runs with letters beyond ASCII are words and dropped later.
CANDIDATE = r"[\p{L}\p{N}+/_=-]{20,}"
KEY_RUN = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$"
#: Codes of key characters run from '+' to 'z'.
FIRST, WIDTH = 43, 80
#: Mean log-likelihood ratio (nats per character) from which a run is random.
THRESHOLD = 1.0
#: Bounds of the labelled sample the chains are fitted on: documents read for ordinary
#: identifiers, generated strings of each random alphabet.
SAMPLE_DOCUMENTS, SAMPLE_STRINGS = 2_000, 4_000


@dataclass(frozen=True)
class Chains:
    """``ratio[WIDTH * a + b]``: log P(b | a) under the random chain minus the ordinary one."""

    ratio: tuple[float, ...]
    threshold: float = THRESHOLD


def labelled_samples(docs: DataFrame, text: str = "text", key: str = "doc_id",
                     documents: int = SAMPLE_DOCUMENTS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """``token, is_random``: generated keys in the usual alphabets, and what people write as
    names: the names of Spark's own functions, and the words of at most ``documents`` documents
    outside base spans, alone and put together as identifiers with ``_``, ``-`` and numbers."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    random = spark.range(strings).select(F.explode(F.array(
        F.substring(digest, 1, 40), raw, F.regexp_replace(raw, "[+/=]", ""),
        F.upper(F.regexp_replace(raw, "[+/=]", "")), F.lower(F.regexp_replace(raw, "[+/=]", "")),
    )).alias("token")).withColumn("is_random", F.lit(True))
    ids = smallest_ids(docs, documents, key)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    names = spark.createDataFrame([(f.name,) for f in spark.catalog.listFunctions()], "n string")
    styles = [F.col("n"), F.upper("n"), F.replace(F.initcap(F.replace(F.col("n"), F.lit("_"), F.lit(" "))), F.lit(" ")), F.concat("n", F.lit("_2024"))]
    known = names.select(F.explode(F.array(*styles)).alias("token")).withColumn("is_random", F.lit(False))
    # No filter and no inner explode here: either would be evaluated on all documents before the join.
    words = docs.join(F.broadcast(ids), key, "left_semi").select(
        F.filter(F.split(plain, r"[^A-Za-z0-9+/_=-]+"), lambda w: F.length(w) >= 3).alias("w"))
    at = lambda i: F.get("w", i)
    joined = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.concat(
        at(i), F.when(i % 3 == 0, F.lit("_")).when(i % 3 == 1, F.lit("-")).otherwise(F.lit("")),
        F.coalesce(F.initcap(at(i + 1)), F.lit("v")), F.when(i % 5 == 0, (i % 2024).cast("string")).otherwise(F.lit("")),
    ))
    made = F.when(F.size("w") > 0, F.concat("w", joined))
    ordinary = words.select(F.explode_outer(made).alias("token")).withColumn("is_random", F.lit(False))
    return random.union(ordinary).union(known)


def train(samples: DataFrame, threshold: float = THRESHOLD, smooth: float = 0.5) -> Chains:
    """Fit both chains on ``token, is_random``; at most two tables of 80 x 80 counts reach the
    driver."""
    chars = samples.select("is_random", F.split("token", "").alias("c")).where(F.size("c") > 1)
    code = lambda c: F.ascii(c) - FIRST
    pairs = chars.select("is_random", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("c") - 1),
        lambda i: code(F.get("c", i - 1)) * WIDTH + code(F.get("c", i)),
    )).alias("pair"))
    rows = pairs.where(F.col("pair").between(0, WIDTH * WIDTH - 1)).groupBy("is_random", "pair").count().collect()
    counts = {True: [0] * (WIDTH * WIDTH), False: [0] * (WIDTH * WIDTH)}
    for r in rows:
        counts[r["is_random"]][r["pair"]] += r["count"]
    kept = [i for i in range(WIDTH) if chr(FIRST + i).isalnum() or chr(FIRST + i) in "+/_=-"]
    ratio = [0.0] * (WIDTH * WIDTH)
    for a in kept:
        sums = {k: sum(v[a * WIDTH + b] for b in kept) + smooth * len(kept) for k, v in counts.items()}
        for b in kept:
            p = {k: (v[a * WIDTH + b] + smooth) / sums[k] for k, v in counts.items()}
            ratio[a * WIDTH + b] = math.log(p[True]) - math.log(p[False])
    return Chains(tuple(round(x, 4) for x in ratio), threshold)


def mean_ratio(token: Column, chains: Chains) -> Column:
    """Mean log-likelihood ratio of the transitions of ``token`` (key characters only)."""
    table = F.split(F.lit(",".join(map(repr, chains.ratio))), ",").cast("array<double>")

    def score(c: Column) -> Column:
        code = lambda i: F.ascii(F.get(c, i)) - FIRST
        total = F.aggregate(
            F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0),
            lambda acc, i: acc + F.coalesce(F.get(table, code(i - 1) * WIDTH + code(i)), F.lit(0.0)),
        )
        return F.when(F.size(c) > 1, total / (F.size(c) - 1)).otherwise(F.lit(0.0))

    return let(F.split(token, ""), score)


def places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """``array<struct<start, kind, end, value>>`` of all matches, leftmost and apart.

    Code points before a match are those of the pieces and matches before it.  ``keep`` gets
    (match, its group 2) and filters after matching."""
    group = 2 if keep is not None else 0
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def place(m: Column) -> Column:
        def step(pieces: Column) -> Column:
            state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
            starts = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), state, lambda acc, i: let(
                acc["at"] + F.length(F.get(pieces, i)),
                lambda start: F.struct((start + F.length(F.get(m, i))).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts")),
            ))["starts"]
            return F.transform(starts, lambda s, i: F.struct(
                s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(F.get(m, i))).alias("end"), F.get(m, i).alias("value")))
        return let(F.split(text, pattern, -1), step)

    def kept(m: Column) -> Column:
        if keep is None:
            return place(m)
        return let(found(group), lambda g: F.filter(place(m), lambda s, i: keep(F.get(g, i))))

    return let(found(0), lambda m: F.when(F.size(m) == 0, none).otherwise(kept(m)))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind."""
    return F.array_sort(F.concat(
        places(text, ASSIGN, 0, keep=lambda g: F.length(g) >= ASSIGN_VALUE), places(text, ACCESS, 1), places(text, HEX, 2),
    ))


def joined(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, chains: Chains, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of ``start, kind, end, value``.

    A span of the method that touches a base span is left out; base spans always stay."""
    body = F.coalesce(F.col(text), F.lit(""))

    def random_runs(base: Column) -> Column:
        apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        runs = F.filter(places(body, CANDIDATE, 3), lambda s: s["value"].rlike(KEY_RUN))
        return F.filter(runs, lambda s: F.when(apart(s), mean_ratio(s["value"], chains) > chains.threshold).otherwise(F.lit(False)))

    both = let(base_spans(body), lambda base: F.struct(base.alias("base"), F.array_sort(F.concat(base, random_runs(base))).alias("spans")))
    found = docs.withColumn("_found", both)
    return found.withColumns({"base": F.col("_found.base"), "spans": F.col("_found.spans")}).drop("_found")


def mask(text: str | Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(spans, state, lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"),
        F.when(s["start"] < acc["at"], acc["parts"])
        .otherwise(F.concat(acc["parts"], F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("parts"),
    )))
    whole = let(cut, lambda c: F.concat(F.array_join(c["parts"], ""), F.substring(body, c["at"] + 1, F.lit(2**31 - 1) - c["at"])))
    return F.when(F.size(spans) > 0, whole).otherwise(F.col(text) if isinstance(text, str) else text)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def secret_report(docs: DataFrame, chains: Chains, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    found = scan(docs.select(key, F.col(text).alias("_text")), chains, "_text")
    return found.select(
        key, *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count_kind(F.col("spans"), "markov").alias("n_markov"),
    )
