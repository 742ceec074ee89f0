"""Rendezvous hashing of stable keys over weighted shards.

Law ``key``: every shard draws a number from the hash of (key, shard), ``-ln(u) / weight``, and
the smallest draw takes the row.  The draws of the old shards do not change when a shard is
added, so a row either stays or goes to the new one.

Nulls, repeats, ties: a NULL key is a key like any other; rows of one key meet in one shard; a
tie of draws goes to the lower shard; a NULL text has no bytes.  Other columns are ignored.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm.common import stored

SHARDS = 24
#: Bytes a record takes besides its text.
RECORD_BYTES = 8


def draws(key: Column, weights: Sequence[float], seed: int = 42) -> Column:
    """``array<struct<draw, shard>>``: what each shard draws for a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    numbered = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def draw(x: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, x["shard"], F.lit(seed)), 11)
        unit = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(unit) / x["weight"]).alias("draw"), x["shard"].alias("shard"))

    return F.transform(numbered, draw)


def shard_of(key: Column, weights: Sequence[float], seed: int = 42) -> Column:
    """The shard of a key."""
    return F.array_min(draws(key, weights, seed))["shard"]


def with_slots(rows: DataFrame, group: str, slot: str) -> DataFrame:
    """Number the rows of every group from 0 without gaps; no task holds a whole group.

    ``rows`` is stored with the place each row was written at.  The rows of a group in one stored
    partition are numbered together, and start behind the earlier partitions of that group."""
    placed = stored(
        rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "slots"
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_row"))
    return (
        placed.withColumn("_place", place).join(starts, [group, "_part"])
        .withColumn(slot, F.col("_start") + F.col("_place") - 1).drop("_part", "_row", "_place", "_start")
    )


def shard_records(
    docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0, seed: int = 42,
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard``: one row per record.

    ``grown_shard`` is the shard once one more of ``grown_weight`` has joined; ``slot`` numbers
    the records of a shard from 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    grown = draws(F.col(key), [*weights, grown_weight], seed)
    n = len(weights)
    rows = docs.select(
        F.col(key), (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), grown.alias("_draws"),
    ).select(
        key, "size", "text_crc32", "law",
        F.array_min(F.slice("_draws", 1, n))["shard"].alias("shard"), F.array_min("_draws")["shard"].alias("grown_shard"),
    )
    out = with_slots(rows, "shard", "slot")
    return out.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
