"""Session helpers: shared storage, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after it was found to hold at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A dictionary of so many times the rows and at most so many bytes still lies in every task, packed by
# column, where joining it would move every word of every text.
LOOKUP_TIMES = 50
LOOKUP_BYTES = 256 << 20
# Lookups up to this many rows may become literals of an expression.
LITERAL_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="vocalis-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/vocalis/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage, so that losing executors costs no recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read back: packed by column, so far smaller
    than a checkpoint, but without its order and placement."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for every row, so that rows with equal or NULL keys stay apart.

    The rows are stored first: the number follows from the place in a stored part, so every
    evaluation gives a row the same number, also one that a lost executor makes necessary, and
    in whatever order the input would arrive a second time."""
    return materialize(df).withColumn(name, F.monotonically_increasing_id())


def has_at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` holds at most ``rows`` rows of together at most ``size`` bytes (written
    as JSON).  One aggregate over ``df``: every partition sends one row."""
    written = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(written).alias("size")).first()
    return found["rows"] <= rows and (found["size"] or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side measured to be small; a larger side is left to a shuffled
    join, where adaptive execution splits skewed partitions."""
    return F.broadcast(df) if has_at_most(df, rows) else df
