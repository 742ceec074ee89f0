"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.session import new_shared_path

#: Separators of words: space and the five control characters 9 to 13.
SPACE = r"\x20\x09-\x0D"
#: Python code works on slices of a batch of about so many bytes, whatever the batch holds.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs and lost executors reread
    it, and no column changes between two evaluations."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def smallest_ids(docs: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """A reproducible sample of at most ``rows`` keys: those of the smallest hash."""
    ids = docs.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(key), key).limit(rows)


def utf8(text: str = "text") -> Column:
    """The bytes of a text; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def chunks(batches: Iterator, size: int = CHUNK_BYTES, column: str = "text") -> Iterator:
    """Slices of Arrow batches of about ``size`` bytes of ``column``; a longer text comes alone."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
