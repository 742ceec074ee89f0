"""Cleaning a growing folder of posts chunk by chunk.

The cleaning chain is stateless, so each new file is cleaned and appended once; a restart
goes on where the checkpoint ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def clean_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    clean: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_chunk: int = 1000,
) -> None:
    """Clean every parquet file in ``source`` not seen before and append it to ``target``."""
    posts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(source)
    query = (
        clean(posts)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
