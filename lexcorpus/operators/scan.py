"""Running extremes over ordered groups of any size.

Rows are range-partitioned by (group, order), so a group may span many partitions. Within a
partition a window does the work; what earlier (or later) partitions of a group contribute is
carried over by a table of at most two rows a partition. A lag is the running maximum of
struct(order, value), a lead the running minimum of what follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexcorpus.staging import Stage


#: Rows of a range at most, about.
RANGE = 1_000_000


def n_ranges(spark: SparkSession, rows: int, each: int = RANGE) -> int:
    """Number of ranges for ``rows`` rows: the session's shuffle partitions, more where a range would hold over ``each`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def running(df: DataFrame, group: list[str], order: list[str], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """``df`` and, per name, the maximum of an expression over all earlier rows of the group (``before``) or its minimum over all later rows (``after``); null where there are none.

    ``order`` must tell the rows of a group apart for a defined result.
    """
    before, after = before or {}, after or {}
    stage = Stage(df.sparkSession, "scan")
    values = {f"__v{i}": c for i, c in enumerate([*before.values(), *after.values()])}
    valued = df.select("*", *[c.alias(k) for k, c in values.items()])
    n = n_ranges(df.sparkSession, df.count())
    rows = stage.write(valued.repartitionByRange(n, *group, *order).withColumn("__pid", F.spark_partition_id()), "ranges")
    names = [*before, *after]
    keys = list(values)
    is_before = {k: i < len(before) for i, k in enumerate(keys)}
    best = lambda k: F.max(k) if is_before[k] else F.min(k)
    past, future = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    edges = rows.groupBy(*group, "__pid").agg(*[best(k).alias(k) for k in keys])
    several = edges.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    by_pid = Window.partitionBy(*group).orderBy("__pid")
    frame = lambda w, k: w.rowsBetween(*(past if is_before[k] else future))
    carried = edges.join(F.broadcast(several), group).select(*group, "__pid", *[best(k).over(frame(by_pid, k)).alias(f"{k}c") for k in keys])
    inside = Window.partitionBy(*group, "__pid").orderBy(*order)
    joined = rows.join(F.broadcast(carried), [*group, "__pid"], "left")
    pick = lambda k: (F.greatest if is_before[k] else F.least)(f"{k}c", best(k).over(frame(inside, k)))
    # greatest and least skip nulls only for several columns: both sides are given
    return joined.select(*df.columns, *[pick(k).alias(name) for name, k in zip(names, keys)])
