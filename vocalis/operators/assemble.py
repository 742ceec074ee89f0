"""Joins and unions that put the master table together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.functions.rows import party_flag
from vocalis.session import broadcast_if_small, materialize


def hydrate_ids(archive: DataFrame, ids: DataFrame, key: str, columns: Sequence[str], reshare: str | None = None) -> DataFrame:
    """Archived posts whose id is listed; ids the archive lacks vanish, reshared posts
    (``reshare`` column not NULL) are dropped."""
    found = archive.join(ids.select(key), key, "left_semi")
    if reshare:
        found = found.where(F.col(reshare).isNull())
    return found.select(*columns)


def join_accounts(posts: DataFrame, accounts: DataFrame, key: str = "user_id", party: str = "party_affiliation") -> DataFrame:
    """Posts of listed accounts with the three-valued ``democrat`` flag.  Posts of unlisted
    accounts drop out, and an account listed twice yields its posts twice."""
    flags = accounts.where(F.col(key).isNotNull()).select(key, party_flag(F.col(party)).alias("democrat"))
    return posts.join(broadcast_if_small(flags), key).select(*posts.columns, "democrat")


def join_predictions(posts: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Inner join; posts without a prediction drop out."""
    return posts.join(predictions, key)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_distinct(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by column name without repeated rows.

    Only hashes of whole rows are shuffled to find those that come more than once; rows of such a
    hash, whether alike or not, are told apart by all columns.  Copies are merged within each task
    before the shuffle, so a hot group of copies stays small."""
    rows = union_all(parts)
    keyed = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    counts = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    repeated = broadcast_if_small(materialize(counts.where(F.col("_n") > 1).select("_hash")))
    once = keyed.join(repeated, "_hash", "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])
    again = keyed.join(repeated, "_hash", "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])
    return once.unionByName(again.distinct())


def make_master(
    democrat: DataFrame, republican: DataFrame, house: DataFrame, senate: DataFrame,
    house_accounts: DataFrame, senate_accounts: DataFrame,
) -> DataFrame:
    """Master table of four cleaned tables with the same columns."""
    return union_distinct([
        democrat.withColumn("democrat", F.lit(True)),
        republican.withColumn("democrat", F.lit(False)),
        join_accounts(house, house_accounts),
        join_accounts(senate, senate_accounts),
    ])
