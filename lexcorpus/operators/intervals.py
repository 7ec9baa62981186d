"""Continuous periods and gaps of intervals per entity.

Keyed state: an ordered map of disjoint intervals per entity. An insertion, in any order, finds the
intervals it touches by binary search and merges them; the gaps are those between neighbours.

An entity may own a third of all rows, so rows are range-partitioned by (entity, start) and each
partition keeps the map of one entity at a time; a task never holds an entity that is larger than its
partition. Entities that lie in one partition are then finished. The others, at most two a partition,
go on in a second keyed pass per (entity, partition): its map starts from the point reached by all earlier partitions (a
table of at most two rows a partition), so the periods and gaps inside are final, and only its first
and last period may be pieces of one that crosses the border. These, at most two a partition, are
merged by a third map per entity.

``periods_stream`` keeps the same map as arbitrary state of Structured Streaming.

Defined cases: rows with a null entity, a null bound or start >= end are no intervals; repeated
rows change nothing; an interval continues a period if it starts at most ``slack`` microseconds
after the end reached so far; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexcorpus.operators.scan import n_ranges
from lexcorpus.staging import Stage

SECOND = 1_000_000


class IntervalMap:
    """Disjoint [start, end] intervals in order, with the gaps between them."""

    def __init__(self, slack: int = SECOND, starts: list[int] = (), ends: list[int] = ()):
        self.slack, self.starts, self.ends = slack, list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        """Add an interval; every interval within ``slack`` of it becomes one with it."""
        lo = bisect_left(self.ends, start - self.slack)
        hi = bisect_right(self.starts, end + self.slack)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))

    def rows(self) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all periods and gaps."""
        return [("period", *x) for x in zip(self.starts, self.ends)] + [("gap", *x) for x in self.gaps()]


_COLUMNS = ["entity", "kind", "s", "e"]
_SCHEMA = "entity string, kind string, s bigint, e bigint"


def _fold(slack: int):
    """Periods and gaps of the entities of a partition; the rows of an entity stand together, in any order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, state, out = None, IntervalMap(slack), []
        for batch in batches:
            for e, s, t in zip(batch["entity"], batch["s"].tolist(), batch["e"].tolist()):
                if e != entity:
                    out += [(entity, *x) for x in state.rows()]
                    entity, state = e, IntervalMap(slack)
                state.insert(s, t)
            yield pd.DataFrame(out, columns=_COLUMNS)
            out = []
        yield pd.DataFrame([(entity, *x) for x in state.rows()], columns=_COLUMNS)

    return run


def _carried(slack: int):
    """Periods and gaps of one entity in one partition, going on from what earlier partitions reached; ``border``: a period that may cross into another."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, carry = IntervalMap(slack), pdf["carry"].iloc[0]
        begun = not pd.isna(carry)
        if begun:
            # the period that reached so far began before all of these
            state.insert(min(int(carry), int(pdf["s"].min())), int(carry))
        for s, e in zip(pdf["s"].tolist(), pdf["e"].tolist()):
            state.insert(s, e)
        out = pd.DataFrame([(key[0], *x) for x in state.rows()], columns=_COLUMNS)
        n = len(state.starts)
        out["border"] = [i == n - 1 or (begun and i == 0) for i in range(n)] + [False] * (n - 1)
        return out

    return run


def _merged(slack: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = IntervalMap(slack)
        for s, e in zip(pdf["s"].tolist(), pdf["e"].tolist()):
            state.insert(s, e)
        return pd.DataFrame([(key[0], "period", *x) for x in zip(state.starts, state.ends)], columns=_COLUMNS)

    return run


def _micros(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, s, e) of the rows that are intervals."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp"))
    return df.select(F.col(entity).cast("string").alias("entity"), micros(start).alias("s"), micros(end).alias("e")).where("entity is not null and s < e")


def periods(df: DataFrame, entity: str, start: str, end: str, slack: int = SECOND) -> DataFrame:
    """(entity, kind, start_at, end_at): the longest continuous ``period``s and the ``gap``s between them."""
    stage = Stage(df.sparkSession, "intervals")
    rows = _micros(df, entity, start, end)
    n = n_ranges(df.sparkSession, rows.count())
    ordered = rows.repartitionByRange(n, "entity", "s", "e").sortWithinPartitions("entity")
    pieces = stage.write(ordered.mapInPandas(_fold(slack), _SCHEMA).withColumn("pid", F.spark_partition_id()), "pieces")  # fixes pid

    reach = pieces.groupBy("entity", "pid").agg(F.max("e").alias("reach"))
    several = reach.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity")
    # at most two entities of a partition go on elsewhere: 2 rows a partition
    before = Window.partitionBy("entity").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage.write(reach.join(F.broadcast(several), "entity").select("entity", "pid", F.max("reach").over(before).alias("carry")), "carried")
    alone = pieces.join(F.broadcast(carried.select("entity").distinct()), "entity", "left_anti").drop("pid")
    crossing = pieces.where("kind = 'period'").join(F.broadcast(carried), ["entity", "pid"]).groupBy("entity", "pid").applyInPandas(_carried(slack), f"{_SCHEMA}, border boolean")
    crossing = stage.write(crossing, "crossing")
    joined = crossing.where("border").groupBy("entity").applyInPandas(_merged(slack), _SCHEMA)
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    out = alone.unionByName(crossing.where("not border").drop("border")).unionByName(joined)
    return out.select("entity", "kind", at("s").alias("start_at"), at("e").alias("end_at"))


def periods_stream(df: DataFrame, entity: str, start: str, end: str, slack: int = SECOND) -> DataFrame:
    """(entity, kind, start_us, end_us, alive): what a micro-batch changes in the periods and gaps of its entities, from keyed state (update mode).

    Rows that hold from now on are alive, those that held before and no longer do are not. As periods only grow and
    gaps only shrink, no row comes back: what holds is all alive rows without those that have gone.
    The state of an entity is its map, one pair of numbers for each period; starts may come in any order
    and at any time, so it is kept.
    """

    def fold(key, batches, state):
        starts, ends = state.get if state.exists else ([], [])
        kept = IntervalMap(slack, starts, ends)
        before = dict.fromkeys(kept.rows())
        for b in batches:
            for s, e in zip(b["s"].tolist(), b["e"].tolist()):
                kept.insert(s, e)
        state.update((kept.starts, kept.ends))
        now = dict.fromkeys(kept.rows())
        out = [(key[0], *x, True) for x in now if x not in before] + [(key[0], *x, False) for x in before if x not in now]
        yield pd.DataFrame(out, columns=["entity", "kind", "start_us", "end_us", "alive"])

    return _micros(df, entity, start, end).groupBy("entity").applyInPandasWithState(fold, "entity string, kind string, start_us bigint, end_us bigint, alive boolean", "starts array<bigint>, ends array<bigint>", "update", "NoTimeout")
