"""The sentiment rules against a plain word-by-word scorer."""

import math
import string

import pytest
from pyspark.sql import functions as F

from vocalis.functions import words as W
from vocalis.operators.lexicon_sentiment import lexicon_sentiment, sentiment_words

LEXICON = {"good": 1.9, "happy": 2.7, "bad": -2.5, "kind": 2.4, "very": 1.0, "sad": -2.1, "least": 0.4, "no": -1.2, "cut": -1.1, "mustard": 0.3}
TEXTS = [
    "I am not happy", "very good", "good!!!", "GOOD stuff and more", "VERY good it is", "so so very bad, not good",
    "It was good but the end was bad", "good BUT bad", "kind of good", "a kind man", "never so good", "never this ever good",
    "the least good", "at the least good thing", "at least good", "very least happy", "isn't it good", "aren't you HAPPY now??",
    "what??? is this good????", "he could cut the mustard today", "that bad ass", "", None, "a b c", "\"good\" 'good good,", "just enough bad good",
    "no good no bad", "without any good", "hardly ever very sad!", "good" * 3 + " good", "sort of an happy end", "this is so happy",
]


def words_of(text):
    out = []
    for w in text.split():
        if len(w) <= 1:
            continue
        for m in W.PUNCTUATION_MARKS:
            for core in ([w[len(m):]] if w.startswith(m) else []) + ([w[:-len(m)]] if w.endswith(m) else []):
                if len(core) > 1 and not any(c in string.punctuation for c in core):
                    w = core
        out.append(w)
    return out


def negates(w):
    return w.lower() in W.NEGATIONS or "n't" in w.lower()


def score(text):
    ws = words_of(text or "")
    n_caps = sum(w.isupper() for w in ws)
    mixed = 0 < n_caps < len(ws)
    but = ws.index("but") if "but" in ws else ws.index("BUT") if "BUT" in ws else None
    values = []
    for i, w in enumerate(ws):
        low = w.lower()
        nxt = ws[i + 1].lower() if i + 1 < len(ws) else ""
        if low not in LEXICON or low in W.BOOSTERS_UP + W.BOOSTERS_DOWN or (low == "kind" and nxt == "of"):
            values.append(0.0)
            continue
        v = LEXICON[low]
        if w.isupper() and mixed:
            v += W.CAPS if v > 0 else -W.CAPS
        free = [i > k and ws[i - k - 1].lower() not in LEXICON for k in range(3)]
        for k in range(3):
            if not free[k]:
                continue
            p = ws[i - k - 1]
            s = W.BOOST if p.lower() in W.BOOSTERS_UP else -W.BOOST if p.lower() in W.BOOSTERS_DOWN else 0.0
            if s:
                s = -s if v < 0 else s
                if p.isupper() and mixed:
                    s += W.CAPS if v > 0 else -W.CAPS
            v += s * (1, 0.95, 0.9)[k]
            so1 = ws[i - 1] in ("so", "this")
            if k == 1 and p == "never" and so1:
                v *= 1.5
            elif k == 2 and ((p == "never" and ws[i - 2] in ("so", "this")) or so1):
                v *= 1.25
            elif negates(p):
                v *= W.NEGATE
            if k == 2:
                spans = [(i - 1, i), (i - 2, i), (i - 2, i - 1), (i - 3, i - 1), (i - 3, i - 2)]
                idiom = next((W.IDIOMS[s] for s in (" ".join(ws[a:b + 1]) for a, b in spans) if s in W.IDIOMS), None)
                v = v if idiom is None else idiom
                for length in (2, 3):
                    if i + length <= len(ws):
                        v = W.IDIOMS.get(" ".join(ws[i:i + length]), v)
                pairs = {" ".join(p) for p in W.BOOSTER_PAIRS_DOWN}
                if " ".join(ws[i - 3:i - 1]) in pairs or " ".join(ws[i - 2:i]) in pairs:
                    v -= W.BOOST
        if free[0] and ws[i - 1].lower() == "least" and not (i > 1 and ws[i - 2].lower() in ("at", "very")):
            v *= W.NEGATE
        values.append(v * (1 if but is None or i == but else 0.5 if i < but else 1.5))
    if not values:
        return 0.0, 0.0, 0.0, 0.0
    bangs, asks = text.count("!"), text.count("?")
    amp = min(bangs, 4) * 0.292 + (0 if asks <= 1 else asks * 0.18 if asks <= 3 else 0.96)
    total = sum(values)
    total += amp if total > 0 else -amp if total < 0 else 0
    pos = sum(v + 1 for v in values if v > 0)
    neg = sum(1 - v for v in values if v < 0)
    neu = sum(v == 0 for v in values)
    pos, neg = pos + (amp if pos > neg else 0), neg + (amp if neg > pos else 0)
    mass = pos + neg + neu
    return neg / mass, neu / mass, pos / mass, total / math.sqrt(total * total + 15)


@pytest.mark.parametrize("literal_rows", [0, 10_000])
def test_against_plain_scorer(spark, literal_rows):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    got = {r["id"]: r for r in lexicon_sentiment(df, lexicon, ["id"], literal_rows=literal_rows).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        row = [got[i][c] for c in ("negative", "neutral", "positive", "compound")]
        assert row == pytest.approx(list(score(text)), abs=6e-4), text


def test_last_valence_wins(spark):
    df = spark.createDataFrame([(1, "good day")], "id long, text string")
    lexicon = spark.createDataFrame([("good", 3.0, 1), ("good", -1.0, 2)], "token string, valence double, ord int")
    assert lexicon_sentiment(df, lexicon, ["id"]).first()["negative"] > 0


def test_words(spark):
    text = "so, (so) 'tis A b! ok!! \"no\" a-b, x.."
    df = spark.createDataFrame([(text,)], "t string").select(sentiment_words(F.col("t")))
    assert df.first()[0] == words_of(text) == ["so", "(so)", "tis", "b!", "ok", "\"no\"", "a-b,", "x.."]


@pytest.mark.parametrize("literal_rows", [0, 10_000])
def test_rows_with_equal_ids_stay_apart(spark, literal_rows):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0), (None, 1.0), ("very", 1.5)], "token string, valence double")
    docs = spark.createDataFrame([(1, "very good day"), (1, "not bad at all"), (1, "very good day"), (None, "plain"), (None, None), (2, "")], "id long, text string")
    got = lexicon_sentiment(docs, lexicon, ["id"], literal_rows=literal_rows).collect()
    assert len(got) == 6 and sorted(r["id"] is None for r in got) == [False] * 4 + [True] * 2
    alone = {t: lexicon_sentiment(docs.where(F.col("text") == t).limit(1), lexicon, ["id"]).first()["compound"] for t in ("very good day", "not bad at all")}
    assert sorted(r["compound"] for r in got) == sorted([alone["very good day"]] * 2 + [alone["not bad at all"], 0.0, 0.0, 0.0])
