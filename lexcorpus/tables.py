"""Readers of the corpus tables, and their de-duplicated record views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(df: DataFrame, key: str, columns: list[str], newest: list[str] = ()) -> DataFrame:
    """One row per ``key`` with ``columns``: the copy with the greatest (``newest``, columns).

    Rows delivered twice are one record. The choice is made by a partial aggregate, so a key
    with very many copies is reduced before the shuffle. Rows with a null key are kept as one
    record with a null key.
    """
    columns = [c for c in columns if c != key]
    pick = F.struct(*[F.col(c) for c in newest], *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    best = df.groupBy(F.col(key)).agg(F.max(pick).alias("_best"))
    return best.select(key, *[F.col(f"_best._{i}").alias(c) for i, c in enumerate(columns)])


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that are costly per row.

    A table of few files (or row groups) would keep most cores idle. Large tables have more partitions than
    that and stay as they are, as do results of a shuffle: nothing is run to find out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: Blanks as JavaScript's trim and \\s see them (fixed values).
BLANKS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def stripped(col: Column) -> Column:
    """``col`` without surrounding blanks of any kind."""
    return F.regexp_replace(col, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
