"""Column expressions over the typed fields of a post."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode_label(label: Column) -> Column:
    """Label 4 becomes 1, all others stay."""
    return F.when(label == 4, F.lit(1)).otherwise(label)


def is_leadership(source: Column, leadership_sources: Sequence[str]) -> Column:
    return source.isin(list(leadership_sources))


def party_flag(party: Column) -> Column:
    """True for D, false for R, NULL for everything else."""
    return F.when(party == "D", F.lit(True)).when(party == "R", F.lit(False))


def group_label(democrat: Column, leadership: Column) -> Column:
    """Party and leadership as one label; an unknown value of either gives ''."""
    return (
        F.when(democrat & leadership, F.lit("dem-lead"))
        .when(democrat & ~leadership, F.lit("dem-base"))
        .when(~democrat & leadership, F.lit("rep-lead"))
        .when(~democrat & ~leadership, F.lit("rep-base"))
        .otherwise(F.lit(""))
    )


def class_indicator(prediction: Column, value: int) -> Column:
    """1 where the predicted class is ``value``, else 0 (also for NULL)."""
    return F.when(prediction == value, F.lit(1)).otherwise(F.lit(0))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def threshold(probability: Column) -> Column:
    """Nearest class; a probability of exactly one half goes to class 0."""
    return (probability > 0.5).cast("int")
