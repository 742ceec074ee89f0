"""The measures read a whole text few times, and stay those of the plain rules."""

import random

from helpers import measures

from vocalis.llm import quality

WORDS = ["a", "b", "the", "Of", "é", "中文", "#x", "12", "!!", "\x1c", "\x85", " ", "a,b", "-", "{", "null"]
SPACES = [" ", "  ", "\n", "\n\n", " \n ", "\t", "\x0b", "\x0c", "\r\n"]


def test_measures_are_those_of_the_plain_rules(spark):
    """Texts with and without the rarer separators, with blank and equal lines, with repeats of 5 words and shorter ones."""
    pick = random.Random(5)
    texts = [None, "", " ", "\n", "a b c d e", "a b c d e a b c d e", "x a b c d y a b c d z", "a\n\na\n \n \nb", "a\tb c\r\nd"]
    for _ in range(400):
        words, spaces = pick.sample(WORDS, pick.choice([2, 5, 16])), SPACES[: pick.choice([2, 5, 9])]
        texts.append("".join(pick.choice(words) + pick.choice(spaces) for _ in range(pick.choice([1, 4, 6, 7, 12, 60]))))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    got = quality.quality_report(rows, quality.References({}, {})).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(texts[r.doc_id])


def test_whole_texts_are_searched_once_for_all_classes(spark):
    rows = quality.measure(spark.createDataFrame([("a B 1",)], "text string"))
    plan = rows.select("_classes")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(") == 1
    assert rows.first()["_classes"] == [1, 1, 0, 0, 0, 0]


def test_a_word_is_hashed_once_for_all_its_windows(spark):
    rows = quality.measure(spark.createDataFrame([("a b c d e f a b c d e",)], "text string"))
    plan = rows.select("n_repeat_words")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("xxhash64(") == plan.count("xxhash64(lambda ")
    assert rows.first()["n_repeat_words"] == 10
