"""Containers of fixed capacity filled with texts by exact-complement hashing.

A plan is made from the histogram of lengths alone, which has at most ``capacity`` rows whatever
the data. From the longest length down, single lengths, pairs and triples that sum to exactly what
is missing are looked up in indexes of sums and consumed in bulk under their availability counts;
lengths without an exact complement are placed by best fit. The plan is a list of patterns with
multiplicities. Every text then takes the place that its rank among texts of its length has in the
plan; ranks come from partition counts, so a length shared by a third of all texts is no hot group.

Defined cases: a text over the capacity is cut into full pieces and a rest, each a row; texts
without tokens need no room and get no container (null); every row is an item of its own, also one
that repeats another; empty tables give no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.llm.tokens import DEFAULT, ranked, sized
from lexcorpus.staging import Stage
from lexcorpus.tables import spread


Patterns = list[tuple[int, tuple[int, ...]]]


def plan(counts: np.ndarray, capacity: int) -> Patterns:
    """(number of containers, lengths in each); ``counts[n]`` items of length n, up to ``capacity``.

    Exact combinations of many short items can take away what long ones would need: of the plans
    with complements of up to three, two and one item, the one with the fewest containers is taken.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(m for m, _ in p))


def _plan(counts: np.ndarray, capacity: int, most: int) -> Patterns:
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[: len(counts)] = counts
    left[0] = 0
    out: Patterns = []
    if left[capacity]:
        out.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    rest: list[tuple[int, int]] = []

    def use(items: tuple[int, ...]) -> bool:
        kinds = {x: items.count(x) for x in items}
        m = min(int(left[x]) // k for x, k in kinds.items())
        if m:
            for x, k in kinds.items():
                left[x] -= m * k
            out.append((m, items))
        return m > 0

    def pair(total: int, top: int) -> list[tuple[int, int]]:
        """Pairs of available lengths up to ``top`` that sum to ``total``, larger members first."""
        a = np.arange(max(1, total - top), total // 2 + 1)
        a = a[(left[a] > 0) & (left[total - a] > 0) & ((2 * a != total) | (left[a] > 1))]
        return [(int(total - x), int(x)) for x in a]

    def sums(top: int) -> np.ndarray:
        """Index of the sums of two available lengths up to ``top``."""
        there = (left[: top + 1] > 0).astype(np.float64)
        size = 1 << int(2 * top + 2).bit_length()
        f = np.fft.rfft(there, size)
        return np.fft.irfft(f * f, size)[: 2 * top + 2] > 0.5

    for n in range(capacity - 1, 0, -1):
        gap = capacity - n
        if left[n] and gap <= n and left[gap] and (gap != n or left[n] > 1):
            use((n, gap))
        if left[n] and most > 1:
            for a, b in pair(gap, min(n, gap - 1)):
                if not left[n]:
                    break
                use((n, a, b))
        if left[n] and most > 2 and gap > 2:
            top = min(n, gap - 2)
            index = sums(top)
            for a in np.nonzero(left[: top + 1])[0][::-1]:
                if not left[n]:
                    break
                if left[a] and 2 <= gap - a < len(index) and index[gap - a]:
                    for b, c in pair(int(gap - a), min(int(a), int(gap - a) - 1)):
                        if not left[n] or not left[a]:
                            break
                        use((n, int(a), b, c))
        if left[n]:
            rest.append((n, int(left[n])))
            left[n] = 0
    # best fit of what has no exact complement: open containers by the room they still have
    room: dict[int, Patterns] = {}
    open_ = np.zeros(capacity + 1, dtype=bool)
    for n, k in rest:
        while k:
            fits = np.nonzero(open_[n:])[0]
            if len(fits):
                r = n + int(fits[0])
                m, items = room[r].pop()
                if not room[r]:
                    open_[r] = False
                if m > k:
                    room[r].append((m - k, items))
                    open_[r] = True
                    m = k
                r -= n
                items = (*items, n)
                k -= m
            else:
                each = capacity // n  # new containers take as many as fit
                m = max(1, k // each)
                each = min(each, k)
                items, r = (n,) * each, capacity - n * each
                k -= m * each
            if r:
                room.setdefault(r, []).append((m, items))
                open_[r] = True
            else:
                out.append((m, items))
    return out + [g for r in sorted(room) for g in room[r]]


def _places(patterns: Patterns) -> tuple[np.ndarray, ...]:
    """Sorted (length, first rank) of each segment, and its items a container and first container."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for m, items in patterns:
        for n in dict.fromkeys(items):
            each = items.count(n)
            rows.append((n, used.get(n, 0), each, first))
            used[n] = used.get(n, 0) + m * each
        first += m
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


WIDE = np.int64(1) << np.int64(40)


def pack(df: DataFrame, capacities: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT) -> DataFrame:
    """(capacity_id, doc_id, piece, start_token, n_tokens, container_id) of every text and capacity.

    ``capacities`` (capacity_id, capacity_tokens) is a parameter table of a few rows.
    """
    spark = df.sparkSession
    stage = Stage(spark, "packing")
    sizes = sized(spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "text", ["doc_id"], vocabulary)
    sizes = stage.write(sizes.withColumn("pid", F.spark_partition_id()), "sizes")
    limits = {int(r[0]): int(r[1]) for r in capacities.select("capacity_id", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()}
    limit = F.array(*[F.struct(F.lit(c).alias("capacity_id"), F.lit(k).cast("bigint").alias("capacity")) for c, k in sorted(limits.items())]).cast("array<struct<capacity_id:int,capacity:bigint>>")
    pieces = (
        sizes.where("n_tokens > 0")
        .select("doc_id", "pid", "n_tokens", F.inline(limit))
        .select("doc_id", "pid", "capacity_id", "capacity", "n_tokens", F.explode(F.expr("sequence(0L, div(n_tokens - 1, capacity))")).alias("piece"))
        .select("doc_id", "pid", "capacity_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.expr("least(capacity, n_tokens - piece * capacity)").alias("n_tokens"))
    )
    # at most ``capacity`` rows for each capacity
    counts = {c: np.zeros(limits[c] + 1, dtype=np.int64) for c in limits}
    for c, n, k in pieces.groupBy("capacity_id", "n_tokens").count().collect():
        counts[c][n] = k
    places = {c: _places(plan(counts[c], limits[c])) for c in limits}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {c: (p[0] * WIDE + p[1], *p) for c, p in places.items()}
        for b in batches:
            cap, n, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("capacity_id", "n_tokens", "rank"))
            container = np.zeros(b.num_rows, dtype=np.int64)
            for c in np.unique(cap):
                at = np.nonzero(cap == c)[0]
                key, _, start, each, first = index[int(c)]
                i = np.searchsorted(key, n[at] * WIDE + rank[at], side="right") - 1
                container[at] = first[i] + (rank[at] - start[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("capacity_id", "doc_id", "piece", "start_token", "n_tokens")], pa.array(container)], names=["capacity_id", "doc_id", "piece", "start_token", "n_tokens", "container_id"])

    out = "capacity_id int, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, container_id bigint"
    rows = ranked(pieces, ["capacity_id", "n_tokens"], ["doc_id", "piece"]).select("capacity_id", "doc_id", "piece", "start_token", "n_tokens", "rank")
    placed = rows.mapInArrow(place, out)
    none = sizes.where("n_tokens = 0").select("doc_id", "n_tokens", F.inline(limit)).select("capacity_id", "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start_token"), "n_tokens", F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(none)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, n_containers, n_tokens, fill): how full the containers of :func:`pack` are."""
    used = packed.where("container_id is not null").groupBy("capacity_id").agg((F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens")), "capacity_id").select("capacity_id", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))
