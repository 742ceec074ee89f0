"""Group statistics, reshapes, metrics and intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.functions.text import explode_each
from vocalis.functions.words import GROUPS

SCORES = ["negative", "neutral", "positive", "compound"]
#: Values whose bootstrap draws are in memory together.
VALUES_AT_ONCE = 512


def sentiment_by_group(df: DataFrame, scores: Sequence[str] = SCORES) -> DataFrame:
    """Mean and sample deviation of every score and the number of rows, by party and
    leadership; rows without either are left out."""
    known = df.where(F.col("democrat").isNotNull() & F.col("leadership").isNotNull())
    stats = [f(s).alias(f"{s}_{n}") for s in scores for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return known.groupBy("democrat", "leadership").agg(*stats, F.count(scores[0]).alias(f"{scores[0]}_count"))


def count_by_topic(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    """One row: how many posts carry each topic flag."""
    return df.agg(*[F.sum(F.col(t).cast("int")).alias(t) for t in topics])


def class_size(df: DataFrame, prediction: str = "prediction_class") -> DataFrame:
    return df.groupBy(prediction).agg(F.count(F.lit(1)).alias("n"))


def group_mean(df: DataFrame, value: str = "prediction_class") -> DataFrame:
    """Mean per group; '' is a group of its own."""
    return df.groupBy("group").agg(F.avg(value).alias(f"mean_{value}"))


def topic_group_stats(df: DataFrame, topics: Sequence[str], topic_col: str = "topics") -> DataFrame:
    """``Topic, Group, Mean_Class, Std`` for every topic and group; a cell without posts has
    NULL values.  One pass over the data, however many topics there are."""
    rows = explode_each(
        df.where(F.col("group") != ""), topic_col, "Topic", "group", "prediction_class", "prediction_raw"
    )
    cells = rows.groupBy("Topic", F.col("group").alias("Group")).agg(
        F.avg("prediction_class").alias("Mean_Class"), F.stddev_samp("prediction_raw").alias("Std")
    )
    grid = df.sparkSession.createDataFrame(
        [(t, g) for t in topics for g in GROUPS], "Topic string, Group string"
    )
    return grid.join(cells, ["Topic", "Group"], "left")


def pivot_topic_group(stats: DataFrame) -> DataFrame:
    """One row per topic with ``Mean_Class_<group>`` and ``Std_<group>``."""
    wide = stats.groupBy("Topic").pivot("Group", GROUPS).agg(
        F.first("Mean_Class").alias("Mean_Class"), F.first("Std").alias("Std")
    )
    names = [(f"{g}_{v}", f"{v}_{g}") for v in ("Mean_Class", "Std") for g in GROUPS]
    return wide.select("Topic", *[F.col(f"`{old}`").alias(new) for old, new in names])


def melt_scores(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long form ``ids, variable, value``; rows without a group are left out."""
    doubles = [F.col(v).cast("double").alias(v) for v in values]
    grouped = df.where(F.col("group") != "").select(*ids, *doubles)
    return grouped.unpivot(list(ids), list(values), "variable", "value")


def binary_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision and recall of class 1; a zero denominator gives 0."""
    def share(hit, base):
        return F.when(F.sum(base) > 0, F.sum(hit) / F.sum(base)).otherwise(F.lit(0.0))

    yes, said = F.col(label) == 1, F.col(prediction) == 1
    one = lambda c: F.when(c, 1).otherwise(0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(one(F.col(label) == F.col(prediction)), F.lit(1)).alias("accuracy"),
        share(one(yes & said), one(said)).alias("precision"),
        share(one(yes & said), one(yes)).alias("recall"),
    )


def _value_counts(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))


def _means(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return counts.groupBy(*by).agg((F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"))


def mean_by_cell(long: DataFrame, by: Sequence[str] = ("variable", "group"), value: str = "value") -> DataFrame:
    """The mean part of ``mean_with_ci``."""
    return _means(_value_counts(long, by, value), by, value)


def uniforms(seeds: np.ndarray, rounds: int) -> np.ndarray:
    """Even numbers below one (seeds, rounds), each a mixed hash of its seed and round alone."""
    x = seeds.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """Distribution of a Poisson number: the least number with any weight, and the chances that
    it is at most that, one more, ...; ten deviations to both sides."""
    low, high = max(0, math.floor(mean - 10 * math.sqrt(mean) - 10)), math.ceil(mean + 10 * math.sqrt(mean) + 20)
    k = np.arange(low + 1, high + 1)
    logs = np.concatenate([[0.0], np.cumsum(math.log(mean) - np.log(k))])
    share = np.exp(logs - logs.max())
    return low, np.cumsum(share / share.sum())


def mean_with_ci(
    long: DataFrame, by: Sequence[str] = ("variable", "group"), value: str = "value",
    level: float = 0.95, rounds: int = 1000, seed: int = 0,
) -> DataFrame:
    """Mean per cell and its bootstrap interval: columns ``by``, ``mean``, ``low``, ``high``.

    Rows are first reduced to distinct values with their counts.  A value seen ``c`` times
    then gets the weight Poisson(c) per round, which is what ``c`` single rows would get, so
    the cost follows the number of distinct values and not of rows.
    """
    by = list(by)
    counts = _value_counts(long, by, value)
    means = _means(counts, by, value)
    seeded = counts.withColumn("_seed", F.xxhash64(F.lit(seed), *by, value))
    types = dict(long.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", _round int, _sum double, _weight double"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, rows in batch.groupby(by, dropna=False, sort=False):
                total, weight = np.zeros(rounds), np.zeros(rounds)
                # Values of one count share a table; their draws are looked up in it together.
                for c, same in rows.groupby("_c", sort=True):
                    low, upto = poisson_table(int(c))
                    v, seeds = same[value].to_numpy(float), same["_seed"].to_numpy(np.int64)
                    for at in range(0, len(v), VALUES_AT_ONCE):
                        w = low + np.searchsorted(upto[:-1], uniforms(seeds[at : at + VALUES_AT_ONCE], rounds), side="right")
                        total += v[at : at + VALUES_AT_ONCE] @ w
                        weight += w.sum(axis=0)
                out = {c: [x] * rounds for c, x in zip(by, cell)}
                yield pd.DataFrame({**out, "_round": range(rounds), "_sum": total, "_weight": weight})

    tail = (1 - level) / 2
    draws = seeded.mapInPandas(draw, schema).groupBy(*by, "_round").agg(
        (F.sum("_sum") / F.nullif(F.sum("_weight"), F.lit(0.0))).alias("_mean")
    )
    interval = draws.groupBy(*by).agg(
        F.percentile("_mean", F.lit(tail)).alias("low"), F.percentile("_mean", F.lit(1 - tail)).alias("high")
    )
    return means.join(interval, by)
