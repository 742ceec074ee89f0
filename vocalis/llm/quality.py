"""Quality rules: counts of repetition and symbols, and divergence from language references.

The method compares two histograms of a document with references of each language: shares of
character classes, and shares of the language's commonest words.  The distance is the square
root of the Jensen-Shannon divergence to base 2 (0 same, 1 disjoint), taken to the nearest
language.  A document of at least ``MIN_WORDS`` words in a language that has a reference fails
when either distance exceeds its limit.  Everything runs in column expressions.

Defined results: a NULL or empty text has no words and fails the base rule; shorter documents and
languages without reference (NULL too) are judged by the base rule alone; repeated rows are
judged each; other columns stay as they are unless they bear the name of a result, which then
wins.  An empty table gives no rows; without labelled rows nothing but the base rule applies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vocalis.functions.text import with_once
from vocalis.llm.common import let
from vocalis.session import broadcast_if_small

WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: The method judges documents of at least so many words: shorter histograms are too rough.
GUARD_WORDS = 50
#: Commonest words of a language, and the documents labelled good that make one.
COMMON_WORDS, LEAST_DOCUMENTS = 40, 20
#: A limit is the largest distance of a document labelled good times this.
MARGIN = 1.1
#: Classes counted by what their removal takes away; the last class is the rest of the words.
CLASSES = {"upper": r"[A-Z]+", "digit": r"[0-9]+", "wide": r"[^\x00-\x7F]+", "point": r"[.,;:'\"()?-]+", "bang": r"!+", "symbol": r"[#*$%&|<>]+"}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class References:
    """Shares by language: ``classes[lang]`` in the order of CLASSES and the rest; ``words[lang]``
    a map from word to share; ``slots`` places every word of any language in a table of
    ``len(slots)`` by its hash, without collisions."""

    classes: dict[str, tuple[float, ...]]
    words: dict[str, dict[str, float]]
    slots: tuple[str, ...] = ("",)
    class_limit: float = 1.0
    word_limit: float = 1.0


def _removed(body: Column, pattern: str) -> Column:
    return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))


def _window_hashes(hashes: Column, n: int) -> Column:
    """A hash for every window of ``n`` words, from the hashes of two shorter windows that cover it;
    the last ``n - 1`` are of no window."""
    if n == 1:
        return hashes
    half = (n + 1) // 2
    both = lambda h: F.zip_with(h, F.slice(h, n - half + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))
    return let(_window_hashes(hashes, half), both)


def _repeat_words(words: Column, hashes: Column, n: int = WINDOW) -> Column:
    """Words inside windows of ``n`` words that occur twice or more in ``words``, whose hashes are ``hashes``.

    Hashes of windows tell most documents free of repeats; of the others, the windows that share
    a hash are compared."""
    last = F.size(words) - n

    def repeated(found: Column) -> Column:
        numbered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        grams = let(numbered, lambda w: F.sort_array(F.transform(F.filter(w, lambda x, i: twin(w, x, i, "hash")), lambda x: F.struct(
            F.array_join(F.slice(words, x["at"] + 1, n), " ").alias("gram"), x["at"].alias("at")))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(grams, covered)).otherwise(F.lit(0))

    def twin(sorted_: Column, x: Column, i: Column, by: str) -> Column:
        same = lambda y: F.coalesce(x[by] == y[by], F.lit(False))
        return same(F.get(sorted_, i - 1)) | same(F.get(sorted_, i + 1))

    def covered(grams: Column) -> Column:
        twice = F.filter(grams, lambda g, i: twin(grams, g, i, "gram"))
        places = F.sort_array(F.transform(twice, lambda g: g["at"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda at, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - at, F.lit(n)))), F.lit(0), lambda a, x: a + x))

    return F.when(last < 1, F.lit(0)).otherwise(let(F.slice(_window_hashes(hashes, n), 1, last + 1), repeated))


def _words(body: Column) -> Column:
    """Words of a text; one that no tab, carriage return or rarer separator parts is split at blanks, which is far faster."""
    # In column expressions \S is all but the six characters of SPACE, and one class is faster than a union.
    by_class = F.regexp_extract_all(body, F.lit(r"\S+"), F.lit(0))
    rare = reduce(or_, [body.contains(c) for c in "\t\x0b\x0c\r"])
    return F.when(rare, by_class).otherwise(F.array_remove(F.split(F.replace(body, F.lit("\n"), F.lit(" ")), " "), ""))


def _counts_by_class(body: Column) -> Column:
    """Characters of each class; small letters and white space are of none, and go first."""
    return let(F.regexp_replace(body, r"[a-z\s]+", ""), lambda b: F.array(*[_removed(b, p) for p in CLASSES.values()]))


def _dup_lines(body: Column) -> Column:
    """Lines with a word that equal an earlier line; only lines of which some are equal are searched for words."""
    extra = lambda x: F.size(x) - F.size(F.array_distinct(x))
    with_word = lambda x: F.filter(x, lambda line: line.rlike(r"\S"))
    lines = F.array_remove(F.split(body, "\n", -1), "")
    return let(lines, lambda x: F.when(extra(x) == 0, F.lit(0)).otherwise(let(with_word(x), extra)))


def measure(docs: DataFrame, text: str = "text", once: bool = False) -> DataFrame:
    """``docs`` with the measures of the base rule, ``_words``, their hashes ``_hashes`` and ``_classes``
    (counts).  With ``once`` a later filter on the words does not split the text a second time."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = with_once(docs, _words=_words(body)) if once else docs.withColumn("_words", _words(body))
    hashed = split.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    counted = hashed.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_classes": _counts_by_class(body),
        "n_dup_lines": _dup_lines(body).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words"), F.col("_hashes")).cast("long"),
    })
    symbols = F.get("_classes", F.lit(list(CLASSES).index("symbol")))
    return counted.withColumn("n_symbols", symbols.cast("long"))


def _term(p: Column, q: Column) -> Column:
    """One term of the divergence, in nats."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def _numbers(values) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _distance(nats: Column) -> Column:
    return F.sqrt(F.greatest(nats, F.lit(0.0)) / math.log(2))


def class_distance(shares: Column, refs: References) -> Column:
    """Least distance of class shares to any language."""
    known = F.array(*[_numbers(q) for q in refs.classes.values()])
    return F.array_min(F.transform(known, lambda q: _distance(_total(F.zip_with(shares, q, _term)))))


def word_distance(words: Column, hashes: Column, refs: References) -> Column:
    """Least distance of a document's words, given with their hashes, to the common words of any language.

    Words are numbered by their slot; sorted numbers give the counts.  A common word the
    document lacks adds ``share * ln 2 / 2``, so only those it has are visited."""
    slots, n = F.split(F.lit("\x01".join(refs.slots)), "\x01"), len(refs.slots)
    # One expression goes over all languages, so a plan does not grow with their number.
    known = F.array(*[
        F.struct(_numbers([q.get(w, 0.0) for w in refs.slots]).alias("share"), F.lit(1.0 - sum(q.values())).alias("rest"))
        for q in refs.words.values()])
    slot = lambda h: F.pmod(h, F.lit(n)).cast("int")
    numbers = F.sort_array(F.filter(
        F.zip_with(words, hashes, lambda w, h: F.when(F.get(slots, slot(h)) == w, slot(h))), lambda s: s.isNotNull()))

    def nearest(ids: Column) -> Column:
        def of_ids(seen: Column) -> Column:
            first = F.transform(seen, lambda s: F.array_position(ids, s).cast("int"))
            count = let(first, lambda f: F.transform(f, lambda a, i: F.coalesce(F.get(f, i + 1), F.size(ids) + 1) - a))
            pairs = F.zip_with(seen, count, lambda s, c: F.struct(s.alias("slot"), (c / F.size(words)).alias("p")))
            return let(pairs, lambda x: F.array_min(F.transform(known, lambda language: one(x, language))))

        def one(pairs: Column, language: Column) -> Column:
            rest = language["rest"]
            of = lambda x: F.get(language["share"], x["slot"])
            state = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
            done = F.aggregate(F.filter(pairs, lambda x: of(x) > 0), state, lambda a, x: F.struct(
                (a["js"] + _term(x["p"], of(x))).alias("js"), (a["p"] + x["p"]).alias("p"), (a["q"] + of(x)).alias("q")))
            return let(done, lambda a: _distance(
                a["js"] + _term(F.greatest(1 - a["p"], F.lit(0.0)), rest) + (1 - rest - a["q"]) * (math.log(2) / 2)))

        return let(F.array_distinct(ids), of_ids)

    return let(numbers, nearest)


def _shares() -> Column:
    counts = F.concat("_classes", F.array(F.col("word_chars").cast("int") - F.aggregate("_classes", F.lit(0), lambda a, x: a + x)))
    return F.transform(counts, lambda c: c / F.greatest(F.col("word_chars"), F.lit(1)))


def with_distances(measured: DataFrame, refs: References, lang: str = "lang") -> DataFrame:
    """Adds ``class_distance`` and ``word_distance``; NULL for documents the method leaves alone."""
    if not refs.classes:
        return measured.withColumns({"class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")})
    judged = (F.col("n_words") >= GUARD_WORDS) & F.coalesce(F.col(lang).isin(list(refs.classes)), F.lit(False))
    return measured.withColumns({
        "class_distance": F.when(judged, let(_shares(), lambda s: class_distance(s, refs))),
        "word_distance": F.when(judged, word_distance(F.col("_words"), F.col("_hashes"), refs)),
    })


def fit_references(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                   common: int = COMMON_WORDS) -> References:
    """References and limits from all documents labelled good (``quality`` 1, ``toxic`` not 1).

    Every language of LEAST_DOCUMENTS such documents or more has a reference; what reaches the
    driver is bounded by languages x words."""
    good = labels.where((F.col("quality") == 1) & F.coalesce(F.col("toxic") != 1, F.lit(True))).select(key).distinct()
    sample = docs.select(key, F.col(text).alias("_text"), F.col(lang).alias("_lang")).join(broadcast_if_small(good), key, "left_semi")
    rows = measure(sample, "_text", once=True).where((F.col("n_words") >= GUARD_WORDS) & F.col("_lang").isNotNull())
    n = len(CLASSES) + 1
    found = (
        rows.withColumn("_s", _shares()).groupBy("_lang")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"), *[F.avg(F.get("_s", F.lit(i))).alias(f"c{i}") for i in range(n)])
        .where(F.col("docs") >= LEAST_DOCUMENTS).orderBy(F.desc("docs"), "_lang").collect()
    )
    if not found:
        return References({}, {})
    order = Window.partitionBy("_lang").orderBy(F.desc("n"), "w")
    top = (
        rows.where(F.col("_lang").isin([r["_lang"] for r in found])).select("_lang", F.explode("_words").alias("w"))
        .groupBy("_lang", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= common).select("_lang", "w", "n", F.xxhash64("w").alias("h")).collect()
    )
    total = {r["_lang"]: r["words"] for r in found}
    classes = {r["_lang"]: tuple(round(r[f"c{i}"], 6) for i in range(n)) for r in found}
    words: dict[str, dict[str, float]] = {x: {} for x in classes}
    for r in top:
        words[r["_lang"]][r["w"]] = round(r["n"] / total[r["_lang"]], 6)
    hashes = {r["w"]: r["h"] for r in top}
    size = 256
    while len({h % size for h in hashes.values()}) < len(hashes):
        size *= 2
    slots = [""] * size
    for w, h in hashes.items():
        slots[h % size] = w
    refs = References(classes, words, tuple(slots))
    far = with_distances(rows, refs, "_lang").agg(F.max("class_distance").alias("c"), F.max("word_distance").alias("w")).first()
    return References(classes, words, tuple(slots), (far["c"] or 1.0) * MARGIN, (far["w"] or 1.0) * MARGIN)


def judge(docs: DataFrame, refs: References, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the measures, distances, ``base_failed`` and ``kept``."""
    out = with_distances(measure(docs, text), refs, lang)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    far = (F.col("class_distance") > refs.class_limit) | (F.col("word_distance") > refs.word_limit)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False))).drop("_words", "_hashes", "_classes")


def quality_report(docs: DataFrame, refs: References, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: measures, base verdict, verdict and the two distances."""
    rows = judge(docs.select(key, F.col(text).alias("_text"), F.col(lang).alias("_lang")), refs, "_text", "_lang")
    rounded = [F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")]
    return rows.select(key, *MEASURES, "base_failed", "kept", *rounded)
