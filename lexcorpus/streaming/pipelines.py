"""Streaming forms of the ingest path: de-duplication, job state, merges into snapshots.

The corpus engine this covers has no streams of its own; these are extensions for continuous
ingestion and give the same results as the batch operators over all input.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexcorpus.operators.ingest import upsert
from lexcorpus.sources import snapshot


def first_payloads(stream: DataFrame, at: str, text: str, within: str = "1 day") -> DataFrame:
    """The first arrival of each payload within the watermark, with its hash."""
    hashed = stream.withColumn("sha256", F.sha2(F.col(text), 256)).where(F.coalesce(F.length(text), F.lit(0)) > 0)
    return hashed.withWatermark(at, within).dropDuplicatesWithinWatermark(["sha256"])


def windowed_counts(stream: DataFrame, at: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n): events per window and kind; windows close once the watermark passes them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def lifecycle_stream(stream: DataFrame, job: str, kind: str, at: str, failure: str) -> DataFrame:
    """(job, last_kind, retry_count, n_events): the state of each job touched, kept as keyed state."""

    def fold(key, batches, state):
        last_us, event, last, retries, n = state.get if state.exists else (-1, -1, None, 0, 0)
        for b in batches:
            for us, e, k in zip(b["at_us"].tolist(), b["event_id"].tolist(), b["kind"]):
                n += 1
                retries += k == failure
                if (us, e) >= (last_us, event):
                    last_us, event, last = us, e, k
        state.update((last_us, event, last, retries, n))
        yield pd.DataFrame({"job": [str(key[0])], "last_kind": [last], "retry_count": [retries], "n_events": [n]})

    rows = stream.select(F.col(job).cast("string").alias("job"), F.unix_micros(F.col(at).cast("timestamp_ntz").cast("timestamp")).alias("at_us"), "event_id", F.col(kind).alias("kind"))
    return rows.groupBy("job").applyInPandasWithState(fold, "job string, last_kind string, retry_count bigint, n_events bigint", "last_us bigint, event bigint, last string, retries bigint, n bigint", "update", "NoTimeout")


def merge_into(stream: DataFrame, table: str, key: str, newest: list[str], checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into a table of buckets, rewriting only those it touches; a batch that is run again gives the same state."""

    def merge(batch: DataFrame, _: int) -> None:
        snapshot.merge_buckets(batch, table, key, lambda base, changes: upsert(base, changes, key, newest))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_audit(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """An append-only log."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
