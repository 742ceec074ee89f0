"""A master table that grows chunk by chunk and never holds a row twice.

Every chunk of new files runs through the whole chain as a batch, so any step may shuffle, number
rows or look up lexicons of any size.  Rows are told apart by a hash of all their columns.  The hashes
stand in the master itself, one folder per chunk, and a chunk writes only rows whose hash no other
chunk has.  A chunk that runs again after a failure replaces its own folder, so the table is what
one run over all files would give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vocalis.session import BROADCAST_ROWS, has_at_most, materialize

KEY, CHUNK = "_key", "_chunk"


def row_key(df: DataFrame):
    """Hash of all columns by name, NULLs with a mark of their own; columns in any order."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def new_rows(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Distinct ``rows`` with their key, without those whose key ``known`` has.

    The keys of a chunk are few against those of the table: measured small, they are broadcast and
    the table's keys only scanned; otherwise the two are joined by key."""
    keyed = materialize(rows.withColumn(KEY, row_key(rows)).dropDuplicates([KEY]))
    if known is None:
        return keyed
    own = keyed.select(KEY)
    small = has_at_most(own, BROADCAST_ROWS)
    seen = materialize(known.select(KEY).join(F.broadcast(own) if small else own, KEY, "left_semi"))
    return keyed.join(F.broadcast(seen) if small else seen, KEY, "left_anti")


def read_master(spark: SparkSession, target: str, schema: StructType | None = None) -> DataFrame:
    """The rows of all chunks."""
    reader = spark.read if schema is None else spark.read.schema(schema.add(KEY, "string").add(CHUNK, "long"))
    return reader.parquet(target).drop(KEY, CHUNK)


def add_chunk(rows: DataFrame, target: str, chunk: int) -> None:
    """Add the rows of chunk number ``chunk`` that no other chunk has; doing so again changes
    nothing."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.parquet(target) if there else None
    fresh = new_rows(rows, None if known is None else known.where(F.col(CHUNK) != chunk))
    fresh.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{CHUNK}={chunk}")


def grow_master(
    spark: SparkSession, source: str, schema: StructType, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
    files_per_chunk: int = 1000,
) -> None:
    """Run ``build`` over every parquet file in ``source`` not seen before, some files at a time, and
    add its rows to the table in ``target``.  ``build`` must treat rows independently of the
    rest of their chunk (cleaning, tagging, joins with lookups)."""
    posts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(source)
    query = (
        posts.writeStream.foreachBatch(lambda chunk, number: add_chunk(build(chunk), target, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
