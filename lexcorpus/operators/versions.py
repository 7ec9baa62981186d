"""Versions of documents in time: as-of and current selection, overlaps, succession, violations.

A null bound means unknown for as-of reads (the version covers no instant) but unbounded for the
overlap check. Rows delivered twice count once. Ties of version_number are broken by id. Rows
without a document are in no chain and overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.operators.scan import running

PUBLIC_NOW = ["PUBLISHED"]
PUBLIC_EVER = ["PUBLISHED", "SUPERSEDED"]


def known_bounds() -> Column:
    return F.col("effective_from").isNotNull() & F.col("effective_to").isNotNull()


def covers(instant: str) -> Column:
    """[effective_from, effective_to) holds ``instant``; an instant that can't be read is covered by none."""
    at = F.try_to_timestamp(F.lit(instant)).cast("timestamp_ntz")
    return F.coalesce(known_bounds() & (F.col("effective_from") <= at) & (at < F.col("effective_to")), F.lit(False))


def _latest(versions: DataFrame) -> DataFrame:
    """The row of the greatest (version_number, id) of each document, by a partial aggregate."""
    cols = [c for c in versions.columns if c not in ("document_id", "version_number", "id")]
    best = versions.groupBy("document_id").agg(F.max(F.struct("version_number", "id", *cols)).alias("v"))
    return best.select("document_id", "v.*")


def as_of(versions: DataFrame, instant: str) -> DataFrame:
    """The version of each document in force at ``instant``: the highest number among the public ones that cover it."""
    return _latest(versions.where(F.col("status").isin(PUBLIC_EVER) & covers(instant)))


def current(versions: DataFrame) -> DataFrame:
    """The published version of the highest number of each document."""
    return _latest(versions.where(F.col("status").isin(PUBLIC_NOW)))


def overlaps(versions: DataFrame, closed: bool = True) -> DataFrame:
    """(document_id, id, reached): published versions that start before an earlier one has ended.

    ``closed`` counts touching bounds as an overlap; otherwise intervals are half-open. One row per
    offending version instead of all pairs, so it stays linear in a document with very many.
    """
    low, high = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    rows = versions.where("status = 'PUBLISHED' and document_id is not null").select("document_id", "id", F.coalesce("effective_from", low).alias("s"), F.coalesce("effective_to", high).alias("e")).distinct()
    if not closed:
        rows = rows.where("s < e")
    scanned = running(rows, ["document_id"], ["s", "e", "id"], before={"reached": F.col("e")})
    return scanned.where("s <= reached" if closed else "s < reached").select("document_id", "id", "reached")


def succession(versions: DataFrame) -> DataFrame:
    """(document_id, version_number, id, replaces_id, replaced_by_id, in_force_until): the chain of public versions.

    ``in_force_until`` is the version's own end, else the start of the next one.
    """
    rows = versions.where(F.col("status").isin(PUBLIC_EVER) & F.col("document_id").isNotNull()).select("document_id", "version_number", "id", "effective_from", "effective_to").distinct()
    step = F.struct("version_number", "id", "effective_from")
    chain = running(rows, ["document_id"], ["version_number", "id"], before={"prev": step}, after={"next": step})
    return chain.select("document_id", "version_number", "id", F.col("prev.id").alias("replaces_id"), F.col("next.id").alias("replaced_by_id"), F.coalesce("effective_to", "next.effective_from").alias("in_force_until"))


def next_numbers(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, next_version): highest number plus one, 1 for documents without versions."""
    top = versions.groupBy("document_id").agg(F.max("version_number").alias("top"))
    return documents.select(F.col("id").alias("document_id")).distinct().join(top, "document_id", "left").select("document_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_version"))


def violations(versions: DataFrame) -> DataFrame:
    """(id, violations): what is wrong with a version, for those with anything wrong."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = F.array(
        F.when(F.coalesce(F.col("version_number") < 1, F.lit(True)), "version_number"),
        F.when(blank("content_hash"), "content_hash"),
        F.when(blank("parser_id"), "parser_id"),
        F.when(blank("archive_record_id"), "archive_record_id"),
        F.when(F.col("effective_from") > F.col("effective_to"), "reversed_bounds"),
    )
    return versions.select("id", F.array_compact(checks).alias("violations")).where(F.size("violations") > 0).distinct()


def provenance(versions: DataFrame) -> DataFrame:
    """(document_id, n_versions, n_closed, historical): whether every version of a document has both bounds."""
    v = versions.select("document_id", "id", "effective_from", "effective_to").distinct()
    return v.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(known_bounds()).alias("n_closed"), F.bool_and(known_bounds()).alias("historical"))
