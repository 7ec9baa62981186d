"""References whose target is missing or arrives later.

Parent keys and child references are brought into one long form (target, key, ...) and grouped
by (target, key) with partial aggregates; only the groups without a parent, or whose parent came
after their first reference, are kept. They are then joined back to the references. A key may
own a third of all references, so the groups with the most references are split off: the
``HOT`` most referenced kept groups are a table of at most that many rows by construction and
are broadcast; every other group holds at most 1/HOT of the references and is joined by shuffle.

Defined cases: null and blank keys are no reference (and no parent); keys compare without
surrounding blanks and case; repeated rows are one record; a target delivered several times
exists from its earliest time; a null time on either side is never late; period is null for a
null time; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.tables import stripped

HOT = 1000


@dataclass(frozen=True)
class Target:
    """A table that is referred to."""

    name: str
    df: DataFrame
    key: str
    arrived: str


@dataclass(frozen=True)
class Reference:
    """A column that refers to ``target``."""

    table: str
    df: DataFrame
    row_id: str
    field: str
    target: str
    at: str


def folded(col: Column) -> Column:
    """A key as compared: no surrounding blanks, no case; null where blank."""
    return F.nullif(F.lower(stripped(col)), F.lit(""))


def orphans(targets: list[Target], references: list[Reference]) -> DataFrame:
    """(table_name, row_id, field_name, state, period): one row per reference that is ``missing`` or ``late``."""
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    parents = union([t.df.select(F.lit(t.name).alias("target"), folded(F.col(t.key)).alias("key"), F.lit(True).alias("parent"), stamp(t.arrived).alias("arrived"), F.lit(None).cast("timestamp_ntz").alias("first_at")) for t in targets])
    refs = union(
        [
            r.df.select(F.lit(r.target).alias("target"), folded(F.col(r.field)).alias("key"), F.lit(r.table).alias("table_name"), F.lit(r.field).alias("field_name"), F.col(r.row_id).cast("string").alias("row_id"), stamp(r.at).alias("at"))
            for r in references
        ]
    ).where("key is not null")
    long = parents.where("key is not null").unionByName(refs.select("target", "key", F.lit(False).alias("parent"), F.lit(None).cast("timestamp_ntz").alias("arrived"), F.col("at").alias("first_at")))
    groups = (
        long.groupBy("target", "key")
        .agg(F.max("parent").alias("parent"), F.min("arrived").alias("arrived"), F.min("first_at").alias("first_at"), F.count_if(~F.col("parent")).alias("n"))
        .where("n > 0 and (not parent or arrived > first_at)")
        .select("target", "key", "parent", "arrived", "n")
    )
    hot = F.broadcast(groups.orderBy(F.desc("n"), "target", "key").limit(HOT))
    keys = ["target", "key"]
    cold = groups.join(hot.select(*keys), keys, "left_anti").drop("n")
    joined = refs.join(hot.drop("n"), keys).unionByName(refs.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
    return (
        joined.where("not parent or arrived > at")
        .select("table_name", "row_id", "field_name", F.when(F.col("parent"), "late").otherwise("missing").alias("state"), F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """(table_name, field_name, state, period, n_references) of :func:`orphans`."""
    return found.groupBy("table_name", "field_name", "state", "period").agg(F.count(F.lit(1)).alias("n_references"))
