"""Column expressions that clean and tokenise text.

All of them run inside the JVM.  An argument that is used more than once should be a plain
column; :func:`with_once` attaches a costly expression so that it is evaluated once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.functions.words import EXTRA_STOP_WORDS, STOP_WORDS

# --- fixed values: characters and patterns ----------------------------------------------
# ASCII punctuation without '#' and '@', plus the typographic apostrophe.
PUNCTUATION = "!\"$%&'()*+,-./:;<=>?[\\]^_`{|}~’"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
LETTER = r"\p{L}\p{Nl}\p{No}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
URL = rf"http[^{SPACE}]+"
EMOTICON = r"(?i)8o?[dp@]|[dp@]o?8"
# What a social-media tokenizer can still find once punctuation is gone, in order of
# precedence: phone number, emoticon, handle, hashtag, word, word with digits, any sign.
TOKEN = "|".join([
    rf"(?:[01] *)?(?:{DIGIT}{{3}} *)?{DIGIT}{{3}} *{DIGIT}{{4}}",
    r"8[oO]?[dDpP@]|[dDpP@][oO]?8",
    rf"@[{WORD}]+",
    rf"#+[{WORD}]{{2,}}",
    rf"[{LETTER}]{{3,}}",
    rf"[{WORD}]+",
    rf"[^{SPACE}]",
])
HANDLE = (
    r"@(?<![A-Za-z0-9_!@#$%&*]@)"
    r"(?:[A-Za-z0-9_]{20}(?!@)|[A-Za-z0-9_]{1,19}(?![A-Za-z0-9_]*@))"
)
# The same matches as TOKEN, for Java's engine alone: ASCII is named first, since ranges are faster than
# properties, a phone number is tried only at a digit, and nothing that matched is given back.
ASCII_LETTER, ASCII_WORD = f"a-zA-Z{LETTER}", f"a-zA-Z0-9_{WORD}"
JAVA_TOKEN = "|".join([
    rf"(?=[0-9{DIGIT}])(?:[01] *)?(?:{DIGIT}{{3}} *)?{DIGIT}{{3}} *{DIGIT}{{4}}",
    r"8[oO]?[dDpP@]|[dDpP@][oO]?8",
    rf"[{ASCII_LETTER}]{{3,}}+",
    rf"@[{ASCII_WORD}]++",
    rf"#+[{ASCII_WORD}]{{2,}}+",
    rf"[{ASCII_WORD}]++",
    rf"[^{SPACE}]",
])
# A sign other than an ASCII letter or digit is kept at most three times in a row.  The one property
# is six times as fast as a negated class of ranges.
LONG_RUN = r"(\P{Alnum})\1{3,}"
TOKEN_REPR = r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""
VECTOR_WORD = rf"[{WORD}]{{2,}}"
# ----------------------------------------------------------------------------------------


def with_once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns whose expressions are costly, evaluated exactly once per row.

    A plain ``withColumn`` lets the optimizer copy the expression into every later filter
    and generator; passing it through a one-element generator stops that copying.
    """
    row = F.struct(*[e.alias(name) for name, e in exprs.items()])
    keep = [c for c in df.columns if c not in exprs]
    made = df.select("*", F.explode_outer(F.array(row)).alias("_once"))
    return made.select(*[F.col(f"`{c}`") for c in keep], *[F.col("_once")[n].alias(n) for n in exprs])


def explode_each(df: DataFrame, array: Column | str, name: str, *keep: str) -> DataFrame:
    """One row per array element.  The outer form is used because the inner one adds a
    filter that evaluates the array a second time."""
    out = df.select(*keep, F.explode_outer(array).alias(name))
    return out.where(F.col(name).isNotNull())


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def strip_handles(text: Column) -> Column:
    return F.regexp_replace(text, HANDLE, " ")


def tokenize(text: Column) -> Column:
    """Lower-cased tokens; emoticons keep their case.  A missing text has no tokens."""
    short = F.regexp_replace(F.coalesce(text, F.lit("")), LONG_RUN, "$1$1$1")
    found = F.regexp_extract_all(short, F.lit(JAVA_TOKEN), F.lit(0))
    return F.transform(
        found,
        lambda t: F.when(t.contains("8") & t.rlike(EMOTICON), t).otherwise(F.lower(t)),
    )


def strip_hashtags(tokens: Column, mode: str | None, tags: Sequence[str] = ()) -> Column:
    """``all`` drops every hashtag, ``select`` the listed ones (in any case), None keeps all."""
    if mode == "all":
        return F.filter(tokens, lambda t: ~t.startswith("#"))
    if mode == "select":
        listed = [t.lower() for t in tags]
        return F.filter(tokens, lambda t: ~t.isin(listed))
    if mode is None:
        return tokens
    raise ValueError(f"hashtag mode must be 'all', 'select' or None, not {mode!r}")


def remove_stopwords(tokens: Column, words: Sequence[str] | None = None) -> Column:
    """Drop stop words and one-character tokens."""
    stop = list(words) if words is not None else STOP_WORDS + EXTRA_STOP_WORDS
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(stop))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by an underscore."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat(a, F.lit("_"), b),
    )


def tokens_plus_bigrams(tokens: Column) -> Column:
    return F.concat(tokens, bigrams(tokens))


def filter_marked_bigrams(pairs: Column) -> Column:
    """Drop bigrams in which either part is a hashtag or a handle."""
    return F.filter(pairs, lambda p: ~p.rlike("(^|_)[#@]"))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def vector_words(tokens: Column) -> Column:
    """Words of two or more word characters, as a bag-of-words vectorizer sees the tokens."""
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(VECTOR_WORD), F.lit(0))


def parse_token_list(text: Column) -> Column:
    """Array from the printed form of a list of strings, e.g. ``['a', "don't"]``."""
    quoted = F.regexp_extract_all(text, F.lit(TOKEN_REPR), F.lit(0))
    return F.transform(
        quoted,
        lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"),
    )


def print_token_list(tokens: Column) -> Column:
    """The printed form that :func:`parse_token_list` reads."""
    def quote(t: Column) -> Column:
        escaped = F.replace(t, F.lit("\\"), F.lit("\\\\"))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.when(t.contains("'") & ~t.contains('"'), double).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(tokens, quote), ", "), F.lit("]"))
