"""Snapshots: a table's next state written beside the current one and switched to at once.

A table is a folder of states and a file ``CURRENT`` that names one of them. Writers add a state and
replace the file by a rename; readers see the whole old or the whole new state. Checks run before
the switch, so a state that violates them is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, replacing one that is there at once."""
    fs, part = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, target = hadoop_path(spark, path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(part, target, options)


def _current(spark: SparkSession, table: str) -> str | None:
    fs, p = hadoop_path(spark, f"{table}/CURRENT")
    return read_text(spark, f"{table}/CURRENT") if fs.exists(p) else None


def read(spark: SparkSession, table: str) -> DataFrame | None:
    """The current state; None where there is none."""
    state = _current(spark, table)
    return spark.read.parquet(f"{table}/{state}") if state else None


def _reject(spark: SparkSession, state: str, found: dict[str, DataFrame]) -> None:
    """Remove the new state and raise ValueError if a check gave a row."""
    for name, rows in found.items():
        bad = rows.take(5)
        if bad:
            fs, p = hadoop_path(spark, state)
            fs.delete(p, True)
            raise ValueError(f"rejected by {name}: {bad}")


def write(df: DataFrame, table: str, checks: list[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """Write ``df`` as the next state. Each check gives the offending rows; if any gives a row, nothing changes and ValueError is raised."""
    spark = df.sparkSession
    state = f"state-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{state}")
    written = spark.read.schema(df.schema).parquet(f"{table}/{state}")
    _reject(spark, f"{table}/{state}", {f"check {i}": check(written) for i, check in enumerate(checks)})
    write_text(spark, f"{table}/CURRENT", state)
    return written


def read_all(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of the current state written by :func:`write_all`; None where there is none."""
    state = _current(spark, folder)
    return {n: spark.read.parquet(f"{folder}/{state}/{n}") for n in names} if state else None


def write_all(tables: dict[str, DataFrame], folder: str, checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """Write several tables as one next state: readers see all of them change, or none. Checks as in :func:`write`, over all tables."""
    spark = next(iter(tables.values())).sparkSession
    state = f"state-{uuid.uuid4().hex}"
    written = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{state}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{folder}/{state}/{name}")
    _reject(spark, f"{folder}/{state}", {name: check(written) for name, check in (checks or {}).items()})
    write_text(spark, f"{folder}/CURRENT", state)
    return written


def _manifest(spark: SparkSession, table: str) -> dict:
    state = _current(spark, table)
    return json.loads(state) if state else {"n": 0, "key": None, "buckets": {}, "before": []}


def read_buckets(spark: SparkSession, table: str) -> DataFrame | None:
    """The current state of a table kept by :func:`merge_buckets`; None where there is none."""
    found = _manifest(spark, table)
    if not found["buckets"]:
        return None
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(*[f"{table}/{state}/bucket={b}" for b, state in sorted(found["buckets"].items())])


def merge_buckets(changes: DataFrame, table: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], n: int = 64) -> list[int]:
    """Put ``changes`` into a table laid out in ``n`` buckets of its key, rewriting only buckets that have changes; gives their numbers.

    ``merge`` (rows as they are, changes) gives the rows as they will be; it must keep each row's ``key``. A
    file ``CURRENT`` names the state of every bucket and is replaced at once. States that neither it nor the one before
    names are removed, so readers of the one before are not disturbed.
    """
    spark = changes.sparkSession
    old = _manifest(spark, table)
    n, buckets = old["n"] or n, old["buckets"]
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int").alias("bucket")
    # at most n rows
    touched = sorted(r.bucket for r in changes.select(at).distinct().collect())
    if not touched:
        return []
    there = [f"{table}/{buckets[str(b)]}/bucket={b}" for b in touched if str(b) in buckets]
    base = spark.read.schema(StructType.fromJson(old["schema"])).parquet(*there) if there else spark.createDataFrame([], changes.schema)
    state = f"state-{uuid.uuid4().hex}"
    new = merge(base, changes)
    new.select("*", at).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{table}/{state}")
    fs, _ = hadoop_path(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    full = {str(b) for b in touched if fs.exists(path(f"{table}/{state}/bucket={b}"))}
    now = {b: s for b, s in buckets.items() if int(b) not in touched} | dict.fromkeys(full, state)
    used = sorted(set(now.values()))
    kept = set(used) | set(buckets.values())
    write_text(spark, f"{table}/CURRENT", json.dumps({"n": n, "key": key, "schema": new.schema.jsonValue(), "buckets": now, "before": sorted(set(buckets.values()))}))
    for gone in set(old["before"]) - kept:
        fs.delete(path(f"{table}/{gone}"), True)
    return touched
