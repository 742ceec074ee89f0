"""Reproducible samples and splits in hash order."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.operators.hashorder import cut_keys, hash_rank, order_key, with_cuts
from vocalis.session import broadcast_if_small, materialize


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Uniform sample of ``n`` rows without replacement, in the order of the hashed ``ids``;
    always ``min(n, rows)`` rows, whatever the size and however often ids repeat."""
    return sample_n_per_group(df, n, [], ids, seed)


#: Candidates of one group that a window may order; larger samples go by histogram.
WINDOW_ROWS = 200_000


def _limits(rows: Column, n: int) -> Column:
    """A key below which at least ``n`` of ``rows`` keys lie, but for one draw in a thousand
    million: keys are even, so their number below a share of the range is binomial."""
    share = (F.lit(n + 6 * math.sqrt(n) + 20) / rows) * float(16**13)
    text = F.lower(F.lpad(F.hex(F.floor(F.least(share, F.lit(float(16**13 - 1)))).cast("long")), 13, "0"))
    return F.when(share >= float(16**13 - 1), F.lit("g")).otherwise(text)  # beyond every digit


def _content(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def _same_group(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> Column:
    cond = F.lit(True)
    for g in groups:
        cond = cond & left[g].eqNullSafe(right[f"_g_{g}"])
    return cond


def sample_n_per_group(
    df: DataFrame, n: int, groups: Sequence[str], ids: Sequence[str], seed: int | str = 0, sizes: DataFrame | None = None,
) -> DataFrame:
    """Uniform sample of ``n`` rows of each group; groups with fewer rows are kept whole.

    Rows are taken in the order of their keys, of those that share a key (as rows with equal ids do)
    the first by the hash of their whole content; rows alike in everything are interchangeable.

    The sizes of the groups tell a key that about ``n`` rows lie below: one scan counts (unless
    ``sizes``, the groups and their ``_total``, is given), a second keeps those candidates, and only
    they are ordered.  Ids that repeat can make too few or too many candidates; the histogram of
    keys then finds the exact cut."""
    if n <= 0:
        return df.limit(0)
    names = {g: f"_g_{g}" for g in groups}
    if sizes is None:
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_total"))
    sizes = materialize(sizes.withColumnsRenamed(names).select(*names.values(), "_total", _limits(F.col("_total"), n).alias("_limit")))
    keyed = df.withColumn("_key", order_key(seed, *ids))
    if groups:
        below = keyed.join(broadcast_if_small(sizes), _same_group(keyed, sizes, groups) & (F.col("_key") < F.col("_limit")))
    else:
        row = sizes.first()
        below = keyed.where(F.col("_key") < F.lit(row["_limit"] if row else "")).withColumn("_total", F.lit(row["_total"] if row else 0))
    near = materialize(below.select(*[keyed[c] for c in keyed.columns], "_total"))
    found = near.groupBy(*groups, "_total").agg(F.count(F.lit(1)).alias("_have"))
    seen = found.agg(F.count(F.lit(1)).alias("groups"), F.max("_have").alias("most"), F.max(F.least(F.col("_total"), F.lit(n)) - F.col("_have")).alias("short")).first()
    if seen["groups"] < sizes.where("_total > 0").count() or (seen["short"] or 0) > 0:
        return _sample_by_histogram(df, n, groups, ids, seed)
    if (seen["most"] or 0) > WINDOW_ROWS:
        return _sample_by_histogram(near.select(*[near[c] for c in df.columns]), n, groups, ids, seed)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("_key", "_content"))
    chosen = near.withColumn("_content", _content(df)).withColumn("_place", place).where(F.col("_place") <= n)
    return materialize(chosen.select(*[F.col(f"`{c}`") for c in df.columns]))


def _sample_by_histogram(df: DataFrame, n: int, groups: Sequence[str], ids: Sequence[str], seed: int | str) -> DataFrame:
    """The same sample by exact cut keys, whatever the number of rows and of rows per key."""
    key = order_key(seed, *ids)
    cuts = cut_keys(df, key, lambda total: [F.lit(n)], groups)
    marked = with_cuts(df.withColumn("_key", key), cuts, groups).withColumn("_cut", F.try_element_at("_cuts", F.lit(0))).drop("_cuts")
    below = F.coalesce(F.col("_key") < F.col("_cut.key"), F.lit(True))  # a smaller group has no cut
    at = F.coalesce(F.col("_key") == F.col("_cut.key"), F.lit(False))
    whole = F.coalesce(F.col("_cut.take") == F.col("_cut.n"), F.lit(True))
    clear = marked.where(below | (at & whole)).drop("_key", "_cut")
    split = cuts.where(F.try_element_at("_cuts", F.lit(0))["take"] < F.try_element_at("_cuts", F.lit(0))["n"])
    if split.isEmpty():
        return clear
    tied = marked.where(at & ~whole).withColumns({"_take": F.col("_cut.take"), "_content": _content(df)}).drop("_key", "_cut")
    strata = [*groups, "_take"]
    second = cut_keys(tied, F.col("_content"), lambda total: [F.col("_take")], strata)
    entry = F.try_element_at("_cuts", F.lit(0))
    placed = with_cuts(tied, second, strata).withColumn("_cut", entry).drop("_cuts")
    first = placed.where(F.col("_content") < F.col("_cut.key"))
    same = placed.where(F.col("_content") == F.col("_cut.key")).dropDuplicates([*groups, "_content"])
    copies = same.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_cut.take")))).drop("_copy")
    return clear.unionByName(first.unionByName(copies).select(*[F.col(f"`{c}`") for c in df.columns]))


def sample_lines_per_file(lines: DataFrame, n: int, seed: int | str = 0) -> DataFrame:
    """``n`` lines of each file (columns ``file``, ``value``).  Equal lines of a file are told
    apart by their number among their like, so the sample depends on content alone.  Lines are
    grouped with their like once; what is stored are the candidates of the sample."""
    counted = lines.groupBy("file", "value").agg(F.count(F.lit(1)).alias("_n"))
    each = counted.select("file", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_same"))
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_total"))
    return sample_n_per_group(each, n, ["file"], ["value", "_same"], seed, sizes).drop("_same")


#: Steps of the quantile sketch of ``first_n``.
ACCURACY = 10_000


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """The ``n`` rows of the least numbers or dates in ``order`` (NULLs first), in that order.

    A quantile sketch gives a bound below which at least ``n`` rows lie but few more; only these
    are sorted and merged.  While many more than ``n`` lie there, the next sketch reads them alone."""
    near, rows = df, df.count()
    while rows > 4 * n and n > 0:
        share = n / rows + 2 / ACCURACY
        bound = near.agg(F.percentile_approx(order, F.lit(min(share, 1.0)), F.lit(ACCURACY)).alias("b")).first()["b"] if share < 1 else None
        if bound is None:
            break
        closer = near.where(F.col(order).isNull() | (F.col(order) <= F.lit(bound)))
        left = closer.count()
        if left < n or left > rows / 2:  # the sketch missed, or one value holds most rows
            break
        near, rows = closer, left
    return near.orderBy(order).limit(n)


def _cut_points(total: Column, shares: Sequence[float]) -> list[Column]:
    upto, points = 0.0, []
    for share in list(shares)[:-1]:
        upto = round(upto + share, 12)
        points.append(F.floor(total * F.lit(upto) + F.lit(0.5)))
    return points


def split(
    df: DataFrame,
    shares: Mapping[str, float],
    ids: Sequence[str],
    strata: Sequence[str] = (),
    seed: int | str = 1234,
    name: str = "split",
) -> DataFrame:
    """Label every row with one of the parts; each stratum is cut at the rounded shares."""
    parts, key = list(shares), order_key(seed, *ids)
    cuts = cut_keys(df, key, lambda total: _cut_points(total, list(shares.values())), strata)
    label = F.lit(parts[-1])
    for i in reversed(range(len(parts) - 1)):
        # A cut at rank 0 has no key and takes no row.
        label = F.when(F.coalesce(key <= F.try_element_at("_cuts", F.lit(i))["key"], F.lit(False)), F.lit(parts[i])).otherwise(label)
    return with_cuts(df, cuts, strata).withColumn(name, label).drop("_cuts")


def stratified_split(
    df: DataFrame,
    label: str,
    ids: Sequence[str],
    test: float = 0.1,
    valid: float = 0.2,
    seed: int | str = 1234,
) -> DataFrame:
    shares = {"test": test, "valid": valid, "train": 1 - test - valid}
    return split(df, shares, ids, [label], seed)


def stratified_folds(
    df: DataFrame, label: str, ids: Sequence[str], folds: int = 5, seed: int | str = 1234
) -> DataFrame:
    """Column ``fold``: every label is dealt evenly over the folds."""
    ranked = hash_rank(df, order_key(f"{seed}:fold", *ids), "_rank", [label])
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(folds)).cast("int")).drop("_rank")
