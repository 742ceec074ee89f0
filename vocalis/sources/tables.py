"""Typed tables, lookups, id lists and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.session import new_shared_path

# --- fixed values: schemas of the raw tables (name, type, longest text, required) ---------
POSTS = [
    ("tweet_id", T.StringType(), 20, True), ("tweet_date", T.DateType(), None, False),
    ("tweet_text", T.StringType(), None, False), ("user_id", T.StringType(), 30, True),
    ("retweet_count", T.IntegerType(), None, False), ("favorite_count", T.IntegerType(), None, False),
]
ACCOUNTS = [
    ("token", T.StringType(), 20, False), ("user_id", T.StringType(), 30, False),
    ("link", T.StringType(), 50, False), ("party_affiliation", T.StringType(), 1, False),
]
LABELLED = [
    ("label", T.ShortType(), None, True), ("id", T.StringType(), 20, False),
    ("date", T.DateType(), None, False), ("flag", T.StringType(), 20, False),
    ("user_name", T.StringType(), 30, False), ("text", T.StringType(), None, False),
]
# ----------------------------------------------------------------------------------------
Rules = Sequence[tuple]


def schema_of(rules: Rules) -> T.StructType:
    return T.StructType([T.StructField(n, t, not required) for n, t, _, required in rules])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A stored table.  Text work is bound by the processor, so a table in fewer files than the
    cluster has cores is dealt out evenly; a table of many files is read as it lies."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    # Files are listed only when there are few: a split packs a bounded number of them.
    few = df.rdd.getNumPartitions() < 4 * cores and len(df.inputFiles()) < cores
    return df.repartition(cores) if few else df


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = False, rules: Rules = ()
) -> DataFrame:
    """Header CSV in a fixed schema; any malformed row fails the load, also one that is malformed
    in a column nobody reads.

    With ``rules`` a NULL in a required column or a text beyond its length fails it too.  Files
    are split by default; quoted line breaks need ``multi_line=True``, which reads a file in one
    task, so parallelism then comes from many files."""
    rows = spark.read.csv(
        path, schema=schema, header=True, mode="FAILFAST", multiLine=multi_line, quote='"', escape='"',
        enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    # Only values that are asked for are parsed, so a condition that always holds asks for all.
    read = rows.where(F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in rows.columns])) >= 0)
    return enforce(read, rules) if rules else read


def enforce(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows``, whose evaluation fails at the first row that breaks a rule, whichever columns
    are read."""
    whole = F.lit(True)
    for name, _, size, required in rules:
        c = F.col(f"`{name}`")
        if required:
            whole = F.when(c.isNull(), F.raise_error(F.lit(f"NULL in required column {name}")).cast("boolean")).otherwise(whole)
        if size:
            said = F.concat(F.lit(f"text of more than {size} characters in column {name}: "), F.substring(c, 1, 100))
            whole = F.when(F.length(c) > size, F.raise_error(said).cast("boolean")).otherwise(whole)
    return rows.where(whole)


def _clean_lookup(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    text = lambda c: F.nullif(F.regexp_replace(F.col(c), r"\r", ""), F.lit(""))
    return df.select(*[F.col(c) if c in keep else text(c).alias(c) for c in df.columns])


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Account lookup; carriage returns are removed and blanks are NULL."""
    return _clean_lookup(read_csv(spark, path, schema_of(ACCOUNTS), multi_line=False))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Topic lexicon file ``Bigram,Topic`` as ``bigram, topic, ord``; ``ord`` orders rows as they
    stand in the files: by file, part of the file, and place within the part."""
    schema = T.StructType().add("Bigram", "string").add("Topic", "string")
    rows = read_csv(spark, path, schema)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    placed = rows.select(F.col("Bigram").alias("bigram"), F.col("Topic").alias("topic"), place.alias("ord"))
    return _clean_lookup(placed, ("ord",))


def read_id_list(spark: SparkSession, path: str | list[str], name: str = "id") -> DataFrame:
    """One id per line, no header; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r", "")).alias(name))
    return lines.where(F.col(name) != "")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, value``: every line with the file it comes from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header and no index; arrays become JSON text."""
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
        for f in df.schema
    ]
    df.select(*columns).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue='""')
    return path


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a stored table and read it back.

    With ``path`` the table is parquet in that folder, otherwise a catalog table.  The input may
    read the old table, so it is always written elsewhere first."""
    spark = df.sparkSession
    aside = new_shared_path(spark, name)
    df.write.parquet(aside)
    rows = spark.read.parquet(aside)
    if path is None:
        rows.write.mode("overwrite").format("parquet").saveAsTable(name)
        return spark.table(name)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def check_constraints(df: DataFrame, rules: Rules) -> DataFrame:
    """``column, rule, violations`` for every required column and every longest text, in one
    pass over the table."""
    one = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    checks: Mapping[tuple[str, str], object] = {
        **{(n, "not_null"): one(F.col(n).isNull()) for n, _, _, required in rules if required},
        **{(n, f"max_length_{size}"): one(F.length(n) > size) for n, _, size, _ in rules if size},
    }
    row = df.agg(*[c.cast("long").alias(f"{n}|{r}") for (n, r), c in checks.items()])
    long = row.unpivot([], [F.col(f"`{c}`") for c in row.columns], "_check", "violations")
    return long.select(
        F.split_part("_check", F.lit("|"), F.lit(1)).alias("column"),
        F.split_part("_check", F.lit("|"), F.lit(2)).alias("rule"),
        "violations",
    )
