"""Rule-based sentiment with a valence lexicon (Hutto & Gilbert 2014).

Works on raw text.  Each word sees its own neighbours, so the rules are column expressions
over an exploded array; the lexicon is joined, never looped over.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.functions import words as W
from vocalis.functions.text import SPACE, explode_each, with_once
from vocalis.session import LITERAL_ROWS, has_at_most, with_row_id

_ASCII_MARKS = r"!-/:-@\[-`{-~"
_MARK = "(?:" + "|".join("".join("\\" + c for c in m) for m in W.PUNCTUATION_MARKS) + ")"
_CORE = rf"([^{_ASCII_MARKS}]{{2,}})"
ANY_MARK = rf"^[{_ASCII_MARKS}]|[{_ASCII_MARKS}]$"
WORD_WITH_MARK = rf"^{_MARK}{_CORE}$|^{_CORE}{_MARK}$"
# Neighbours a scored word can see, and the places where it can stand in an idiom.
NEIGHBOURS = {"p3": -3, "p2": -2, "p1": -1, "n1": 1, "n2": 2}
BEFORE = (("p1", "w"), ("p2", "p1", "w"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))
AHEAD = (("w", "n1", "n2"), ("w", "n1"))


def sentiment_words(text: Column) -> Column:
    """Space-separated words of two or more characters, freed of one mark at one end."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: F.length(w) > 1)
    bare = lambda w: F.regexp_replace(w, WORD_WITH_MARK, "$1$2")
    return F.transform(words, lambda w: F.when(w.rlike(ANY_MARK), bare(w)).otherwise(w))


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the strength of a text."""
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    bangs, asks = count("!"), count("?")
    loud = F.least(bangs, F.lit(4)) * 0.292
    asking = F.when(asks <= 1, 0.0).when(asks <= 3, asks * 0.18).otherwise(0.96)
    return loud + asking


def round_even(value: Column, digits: int) -> Column:
    """Round half to even; values a hair off a tie, from summing in another order, count as ties."""
    scaled = value * F.lit(10.0**digits)
    low = F.floor(scaled)
    tie = F.abs(scaled - low - 0.5) < 1e-6
    nearest = F.when(tie, low + F.pmod(low, F.lit(2))).otherwise(F.floor(scaled + 0.5))
    return nearest / F.lit(10.0**digits)


def _is_caps(word: Column) -> Column:
    return (word != F.lower(word)) & (word == F.upper(word))


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _any(conditions: Iterable[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return _sure(found)


def _booster(word: Column) -> Column:
    """Strength that a booster word lends to a positive neighbour; NULL for other words."""
    return F.when(word.isin(W.BOOSTERS_UP), W.BOOST).when(word.isin(W.BOOSTERS_DOWN), -W.BOOST)


def _boost(size: Column, caps: Column, valence: Column) -> Column:
    """Signed strength of a booster for a neighbour of the given valence."""
    signed = F.when(valence < 0, -size).otherwise(size)
    loud = F.when(caps, F.when(valence > 0, W.CAPS).otherwise(-W.CAPS)).otherwise(0.0)
    return F.coalesce(signed + loud, F.lit(0.0))


def _idiom() -> Column:
    """Valence of the idiom a word stands in: one it opens, else the first one behind it."""
    phrases = F.array(*[F.concat_ws(" ", *places) for places in [*AHEAD, *BEFORE]])
    first = F.get(F.filter(phrases, lambda p: p.isin(list(W.IDIOMS))), F.lit(0))
    value = F.lit(None).cast("double")
    for text, valence in W.IDIOMS.items():
        value = F.when(first == text, F.lit(valence)).otherwise(value)
    return value


def _entries(lexicon: DataFrame) -> DataFrame:
    """One valence per lower-case word; of several rows the last one (by ``ord``) counts."""
    lexicon = lexicon.where(F.col("token").isNotNull() & F.col("valence").isNotNull())
    last = F.max_by("valence", F.struct("ord", "valence")) if "ord" in lexicon.columns else F.max("valence")
    return lexicon.groupBy(F.col("token").alias("_token")).agg(last.cast("double").alias("_valence"))


def _with_neighbours(rows: DataFrame, keep: Sequence[str], entries: DataFrame, small: bool) -> DataFrame:
    """One row per word with its neighbours, its ``_valence`` and, for the three words before
    it, whether they are in the lexicon (``k1``..``k3``).

    Words of a lexicon of checked size are recognised by a literal set, so only scored words
    leave the array and the join with the valences is a lookup of those.  A larger lexicon is
    joined for every word.
    """
    rows = with_once(rows, _low=F.transform("_words", F.lower))
    positions = F.when(F.size("_words") > 0, F.sequence(F.lit(1), F.size("_words")))
    known = [r["_token"] for r in entries.select("_token").collect()] if small else []
    if small:
        positions = F.filter(positions, lambda i: F.get("_low", i - 1).isin(known))

    def near(i: Column) -> Column:
        words = [F.get("_words", i - 1 + d).alias(n) for n, d in NEIGHBOURS.items()]
        flags = [_sure(F.get("_low", i - 1 - n).isin(known)).alias(f"k{n}") for n in (1, 2, 3)] if small else []
        return F.struct(i.alias("i"), F.get("_words", i - 1).alias("w"), *words, *flags)

    rows = rows.select(*keep, F.explode_outer(F.transform(positions, near)).alias("x")).select(*keep, "x.*")
    low = F.lower("w")
    rule_word = low.isin(W.BOOSTERS_UP + W.BOOSTERS_DOWN) | ((low == "kind") & (F.lower("n1") == "of"))
    rows = rows.withColumns({"_key": low, "_ruled": _sure(rule_word)})
    rows = rows.join(F.broadcast(entries) if small else entries, F.col("_key") == F.col("_token"), "left")
    if not small:
        # What one lookup found of a text's words tells each word about those before it.
        text = Window.partitionBy("_row").orderBy("i")
        rows = rows.withColumns({f"k{n}": F.lag(F.col("_token").isNotNull(), n, False).over(text) for n in (1, 2, 3)})
    rows = rows.withColumn("_valence", F.when(~F.col("_ruled"), F.col("_valence")))
    return rows.drop("_key", "_token", "_ruled")


def _with_cues(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """What the rules need to know of the neighbours, each worked out once per row."""
    c, back = F.col, (1, 2, 3)
    rows = rows.select(
        "*",
        *[F.lower(f"p{n}").alias(f"_l{n}") for n in back],
        F.concat_ws(" ", "p3", "p2", "p1", "w", "n1", "n2").alias("_around"),
    )
    pairs = [(c(a) == x) & (c(b) == y) for a, b in (("p3", "p2"), ("p2", "p1")) for x, y in W.BOOSTER_PAIRS_DOWN]
    return rows.select(
        *keep, "i", "_valence",
        _sure(c("_mixed") & _is_caps(c("w"))).alias("_loud0"),
        *[_sure(c("_mixed") & _is_caps(c(f"p{n}"))).alias(f"_loud{n}") for n in back],
        # A preceding word counts only if it exists and is not itself in the lexicon.
        *[(c(f"p{n}").isNotNull() & ~c(f"k{n}")).alias(f"_free{n}") for n in back],
        *[_booster(c(f"_l{n}")).alias(f"_boost{n}") for n in back],
        *[_sure(c(f"_l{n}").isin(W.NEGATIONS) | c(f"_l{n}").contains("n't")).alias(f"_not{n}") for n in back],
        *[_sure(c(f"p{n}").isin("so", "this")).alias(f"_so{n}") for n in (1, 2)],
        *[_sure(c(f"p{n}") == "never").alias(f"_never{n}") for n in (2, 3)],
        (_sure(c("_l1") == "least") & ~_sure(c("_l2").isin("at", "very"))).alias("_least"),
        F.when(_any(c("_around").contains(x) for x in W.IDIOMS), _idiom()).alias("_idiom"),
        _any(pairs).alias("_damped"),
    )


def word_valences(
    df: DataFrame, lexicon: DataFrame, ids: Sequence[str], text: str = "text", literal_rows: int = LITERAL_ROWS
) -> DataFrame:
    """``_row`` (a number of the row), ``ids``, the number of words ``n_words`` and the final
    valence ``v`` of every scored word; neutral words may be missing, but every text has at least
    one row.  Ids may repeat or be NULL."""
    numbered = with_row_id(df.select(*ids, text))
    ids = ["_row", *ids]
    rows = with_once(numbered, _words=sentiment_words(F.col(text)))
    rows = rows.select(
        *ids, "_words",
        F.size("_words").alias("n_words"),
        F.size(F.filter("_words", _is_caps)).alias("_caps"),
        F.nullif(F.array_position("_words", "but"), F.lit(0)).alias("_but"),
    )
    rows = rows.select(
        *ids, "_words", "n_words",
        ((F.col("_caps") > 0) & (F.col("_caps") < F.col("n_words"))).alias("_mixed"),
        F.coalesce("_but", F.nullif(F.array_position("_words", "BUT"), F.lit(0))).alias("_but"),
    )
    entries = _entries(lexicon)
    keep = [*ids, "n_words", "_mixed", "_but"]
    rows = _with_neighbours(rows, keep, entries, has_at_most(entries, literal_rows))
    rows = _with_cues(rows, keep)

    c, v = F.col, F.col("_valence")
    shout = F.when(v > 0, W.CAPS).otherwise(-W.CAPS)
    rows = rows.withColumn("_v", F.when(c("_loud0"), v + shout).otherwise(v))
    v = c("_v")
    for n, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        rows = rows.withColumn("_b", v + _boost(c(f"_boost{n}"), c(f"_loud{n}"), v) * weight)
        changed = F.when(c(f"_not{n}"), c("_b") * W.NEGATE).otherwise(c("_b"))
        if n == 2:
            changed = F.when(c("_never2") & c("_so1"), c("_b") * 1.5).otherwise(changed)
        if n == 3:
            emphatic = (c("_never3") & c("_so2")) | c("_so1")
            changed = F.coalesce(c("_idiom"), F.when(emphatic, c("_b") * 1.25).otherwise(changed))
            changed = changed + F.when(c("_damped"), -W.BOOST).otherwise(0.0)
        rows = rows.withColumn("_v", F.when(c(f"_free{n}"), changed).otherwise(v))
    rows = rows.withColumn("_v", F.when(c("_free1") & c("_least"), v * W.NEGATE).otherwise(v))
    # Words before 'but' count half, words after it half as much again.
    turn = F.when(c("i") < c("_but"), 0.5).when(c("i") > c("_but"), 1.5).otherwise(1.0)
    return rows.select(*ids, "n_words", F.when(c("_valence").isNotNull(), v * turn).alias("v"))


def lexicon_sentiment(
    df: DataFrame, lexicon: DataFrame, ids: Sequence[str], text: str = "text", keep: Sequence[str] = (),
    literal_rows: int = LITERAL_ROWS,
) -> DataFrame:
    """``ids, keep, negative, neutral, positive, compound`` of every text.

    ``lexicon(token, valence)`` holds lower-case words.  Every row is a text of its own, also
    where ids repeat or are NULL.  Words of one text are adjacent, so they collapse before the
    shuffle.
    """
    rows = df.withColumn("_amp", emphasis(F.coalesce(F.col(text), F.lit(""))))
    keys = [*ids, *keep, "_amp"]
    v = F.col("v")
    sums = word_valences(rows, lexicon, keys, text, literal_rows).groupBy("_row", *keys, "n_words").agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("_s"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("_p"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("_n"),
        (F.col("n_words") - F.sum(F.when(v != 0, 1).otherwise(0))).alias("_z"),
    )
    s, p, n, z, amp = (F.col(x) for x in ("_s", "_p", "_n", "_z", "_amp"))
    scored = sums.select(
        *ids, *keep, "n_words", z.alias("_z"),
        F.when(s > 0, s + amp).when(s < 0, s - amp).otherwise(s).alias("_s"),
        F.when(p > n, p + amp).otherwise(p).alias("_p"),
        F.when(p < n, n + amp).otherwise(n).alias("_n"),
    )
    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + 15)))

    def share(part: Column) -> Column:
        return F.when(F.col("n_words") > 0, round_even(part / (p + n + z), 3)).otherwise(0.0)

    return scored.select(
        *ids, *keep, share(n).alias("negative"), share(z).alias("neutral"), share(p).alias("positive"),
        round_even(compound, 4).alias("compound"),
    )


def sentiment_by_topic(scored: DataFrame, topics: str = "topics") -> DataFrame:
    """Statistics of all topics in one job: each post is scored once and counted under each of
    its topics."""
    scores = ["negative", "neutral", "positive", "compound"]
    known = scored.where(F.col("democrat").isNotNull() & F.col("leadership").isNotNull())
    rows = explode_each(known, topics, "topic", "democrat", "leadership", *scores)
    stats = [f(s).alias(f"{s}_{n}") for s in scores for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy("topic", "democrat", "leadership").agg(*stats, F.count("negative").alias("negative_count"))
