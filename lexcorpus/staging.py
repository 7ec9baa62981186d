"""Tables written to the shared checkpoint folder to cut lineage.

A staged table survives the loss of any executor, is columnar and compressed, and
gives the next plan real statistics. The folder is the session's
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) is a folder of
our own made. Results are lazy and read these tables, so they stay until they are removed: by
``scope`` around a query and the writing of its result, by ``clear``, or, after a crash, by ``sweep``.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: str | None = None


def folder(spark: SparkSession) -> str:
    """The shared folder for staged tables."""
    global _own
    there = spark.conf.get(_KEY, None)
    if there:
        return there.rstrip("/")
    if _own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lexcorpus-stage-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own = f"file://{made}"
    return _own


_written: list[str] = []


def _remove(spark: SparkSession, places: list[str]) -> int:
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if place in _written:
            _written.remove(place)
    return len(places)


def clear(spark: SparkSession) -> int:
    """Remove every table staged so far; call it once their results are written. Gives their number."""
    return _remove(spark, list(_written))


def sweep(spark: SparkSession, application_id: str) -> None:
    """Remove what an application that has ended left behind."""
    _remove(spark, [f"{folder(spark)}/{application_id}"])


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block are removed at its end: write the results inside it."""
    before = set(_written)
    try:
        yield
    finally:
        _remove(spark, [p for p in _written if p not in before])


class Stage:
    """Staged tables of one operator call, in a folder of the application."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.places = spark, label, []

    def alive(self) -> bool:
        """Whether its tables are still there."""
        return bool(self.places) and all(p in _written for p in self.places)

    def clear(self) -> int:
        """Remove the tables of this call."""
        places, self.places = self.places, []
        return _remove(self.spark, places)

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and read it back; ``by`` lays it out in one directory per value."""
        place = f"{folder(self.spark)}/{self.spark.sparkContext.applicationId}/{self.label}-{uuid.uuid4().hex}"
        _written.append(place)
        self.places.append(place)
        path = f"{place}/{name}"
        writer = df.write.option("compression", "zstd")
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(path)
        # the schema is known: no job to infer it, and no failure where nothing was written
        return self.spark.read.schema(df.schema).parquet(path)
