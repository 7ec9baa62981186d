"""Archived bytes, legacy tables and reports as sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.sources.snapshot import hadoop_path, read_text, write_text


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, named, byte_size, intact): files under ``folder`` re-hashed; their name is the hash they should have."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = F.regexp_extract("path", r"([0-9a-f]{64})$", 1)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.nullif(named, F.lit("")).alias("named"), F.col("length").alias("byte_size")).withColumn("intact", F.coalesce(F.col("sha256") == F.col("named"), F.lit(False)))


def legacy(spark: SparkSession, options: dict[str, str], table: str) -> DataFrame:
    """A table of a legacy database over JDBC, read in parallel where ``options`` give a partition column."""
    return spark.read.format("jdbc").options(**options).option("dbtable", table).load()


def ajax_body(body):
    """The page in an answer: its ``Html`` member where it is JSON, else the answer itself."""
    return F.coalesce(F.get_json_object(body, "$.Html"), body)


def read_checkpoint(spark: SparkSession, path: str, version: int = 1) -> dict | None:
    """State of a crawl, in a folder all hosts share; None where it is missing, unreadable or of another version."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    try:
        state = json.loads(read_text(spark, path))
    except ValueError:
        return None
    return state if isinstance(state, dict) and state.get("version") == version else None


def write_checkpoint(spark: SparkSession, path: str, state: dict, version: int = 1) -> None:
    """Replace the state of a crawl at once."""
    write_text(spark, path, json.dumps({**state, "version": version}))


def clear_checkpoint(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, False)
