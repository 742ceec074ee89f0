"""A reproducible random order that never needs one global sort.

Rows are ordered by an md5 of seed and id.  The leading digits of that key cut the data into
65,536 even buckets, so a histogram of at most 65,536 rows per stratum tells in which bucket
any rank lies; only that bucket is ranked row by row.  Samples and splits become a
comparison of each row's key with an exact cut key, and dense ranks become bucket offset plus
position within the bucket.  No task ever holds a whole stratum, however large.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.session import broadcast_if_small, materialize

BUCKET_DIGITS = 4


def order_key(seed: int | str, *ids: str | Column) -> Column:
    """Random but reproducible sort key of a row.  Parts are escaped and NULL has a mark of its
    own, so different ids have different keys."""
    text = [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    parts = [F.coalesce(F.regexp_replace(x, r"([:\\])", r"\\$1"), F.lit(r"\N")) for x in text]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _histogram(keyed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per (stratum, bucket) with the number of rows before the bucket and in total."""
    whole = Window.partitionBy(*strata)
    counts = keyed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(
        *strata,
        "_bucket",
        "_n",
        (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )


def cut_keys(
    df: DataFrame, key: Column, ranks: Callable[[Column], Sequence[Column]], strata: Sequence[str] = ()
) -> DataFrame:
    """Per stratum, the keys that stand at the given ranks: columns ``strata``, ``_cuts``
    (map from position in ``ranks`` to ``key``, the number ``n`` of rows with this key, and how
    many of them are within the rank, ``take``).  A rank outside 1..n has no entry.

    ``ranks`` receives the size of the stratum and returns the wanted ranks.  Rows of one key
    are counted before they meet, so a key that many rows share is one row here.
    """
    keyed = df.select(*strata, key.alias("_key")).withColumn(
        "_bucket", F.substring("_key", 1, BUCKET_DIGITS)
    )
    wanted = F.array(*[
        F.struct(F.lit(i).alias("cut"), r.cast("long").alias("rank"))
        for i, r in enumerate(ranks(F.col("_total")))
    ])
    inside = F.filter(
        wanted,
        lambda w: (w["rank"] > F.col("_before")) & (w["rank"] <= F.col("_before") + F.col("_n")),
    )
    located = (
        _histogram(keyed, strata)
        .select(*strata, "_bucket", "_before", F.explode(inside).alias("_w"))
        .select(
            *[F.col(s).alias(f"_s_{s}") for s in strata],
            F.col("_bucket").alias("_b"),
            F.col("_w.cut").alias("_cut"),
            (F.col("_w.rank") - F.col("_before")).alias("_place"),
        )
    )
    located = broadcast_if_small(materialize(located))
    same = keyed["_bucket"] == located["_b"]
    for s in strata:
        same = same & keyed[s].eqNullSafe(located[f"_s_{s}"])
    place = Window.partitionBy(*strata, "_cut").orderBy("_key")
    found = (
        keyed.join(located, same)
        .groupBy(*strata, "_cut", "_place", "_key").agg(F.count(F.lit(1)).alias("_same"))
        .withColumn("_upto", F.sum("_same").over(place))
        .where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_same") < F.col("_place")))
    )
    take = F.col("_place") - F.col("_upto") + F.col("_same")
    entry = F.struct(F.col("_cut"), F.struct(F.col("_key").alias("key"), take.alias("take"), F.col("_same").alias("n")))
    return materialize(
        found.groupBy(*strata).agg(F.map_from_entries(F.collect_list(entry)).alias("_cuts"))
    )


def with_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Attach the cut keys of its stratum to every row (column ``_cuts``)."""
    if not strata:
        row = cuts.first()
        entries = [
            x for k, v in (row["_cuts"] if row else {}).items()
            for x in (F.lit(k), F.struct(*[F.lit(v[f]).cast(t).alias(f) for f, t in (("key", "string"), ("take", "long"), ("n", "long"))]))
        ]
        made = F.create_map(*entries) if entries else F.create_map().cast("map<int,struct<key:string,take:bigint,n:bigint>>")
        return df.withColumn("_cuts", made)
    renamed = cuts.select(*[F.col(s).alias(f"_s_{s}") for s in strata], "_cuts")
    small = broadcast_if_small(renamed)
    cond = F.lit(True)
    for s in strata:
        cond = cond & df[s].eqNullSafe(small[f"_s_{s}"])
    return df.join(small, cond, "left").select(*[df[c] for c in df.columns], "_cuts")


def hash_rank(df: DataFrame, key: Column, name: str, strata: Sequence[str] = ()) -> DataFrame:
    """Dense rank 1..n of every row in key order, per stratum."""
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_key")
    ranked = keyed.withColumn("_rn", F.row_number().over(inside))
    offsets = _histogram(keyed, strata).select(
        *[F.col(s).alias(f"_s_{s}") for s in strata], F.col("_bucket").alias("_b"), "_before"
    )
    offsets = broadcast_if_small(materialize(offsets))
    cond = ranked["_bucket"] == offsets["_b"]
    for s in strata:
        cond = cond & ranked[s].eqNullSafe(offsets[f"_s_{s}"])
    return ranked.join(offsets, cond).select(
        *df.columns, (F.col("_before") + F.col("_rn")).cast("long").alias(name)
    )
