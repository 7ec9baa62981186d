"""Parent-child rows of unknown depth resolved by pointer doubling.

Only nodes that have children can be on another node's way up, so the doubling runs on those alone;
every node then takes over the result of its parent in one join.

In the doubling every node starts with a pointer to its parent. A round joins the open rows to the
rows they point to and takes over their pointer, so the jump distance doubles (and the path segments
are concatenated, where paths are asked for); rows pointing to a resolved row are resolved. A row
of depth d is resolved after about log2(d) rounds. Ancestors have every smaller depth, so the
first round that resolves nothing proves that the rows still open never reach a root: they lie
on a circle or below one.

Scale: what open rows point to after a round they or others pointed to before it, so the table that is
looked up is cut down to those rows each round, and resolved rows nothing points to are never read
again. Open rows and that table are shuffled. Once at most ``few`` rows are open (counted), what they point
to is settled by itself, with broadcasts of that table, but for paths, whose size isn't bounded by the
number of rows.

Defined cases: a null or unknown parent makes a root of depth 0; a row that is its own parent
is a circle; repeated rows of an id are one node (the one with the greatest ``newest`` columns,
then the greatest parent id); rows with a null id are no nodes; an empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.staging import Stage
from lexcorpus.tables import records


def hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", newest: list[str] = (), few: int = 200_000, paths: bool = True) -> DataFrame:
    """(node_id, root_id, depth[, path]): path runs from the root to the node.

    Where the walk upwards never ends, root_id is '', depth -1 and path null.
    """
    stage = Stage(nodes.sparkSession, "hierarchy")
    edges = records(nodes.where(F.col(id_col).isNotNull()), id_col, [parent_col], newest).select(F.col(id_col).alias("node"), F.col(parent_col).alias("top"))
    edges = stage.write(edges, "edges")
    inner = edges.join(edges.select(F.col("top").alias("node")).distinct(), "node", "left_semi")
    inner, small = _doubled(stage, inner, few, paths)
    path = [F.when(F.col("k").isNull(), F.array("node")).otherwise(F.concat("k_seg", F.array("node"))).alias("path")] if paths else []
    known = inner.select(F.col("node").alias("k"), F.col("below").alias("k_root"), F.col("dist").alias("k_depth"), *([F.col("seg").alias("k_seg")] if paths else []))
    joined = edges.join(F.broadcast(known) if small and not paths else known, F.col("top") == F.col("k"), "left")
    return joined.select(
        F.col("node").alias("node_id"),
        F.when(F.col("k").isNull(), F.col("node")).otherwise(F.col("k_root")).alias("root_id"),
        F.when(F.col("k").isNull(), 0).when(F.col("k_depth") < 0, -1).otherwise(F.col("k_depth") + 1).cast("bigint").alias("depth"),
        *path,
    )


def _kept(paths: bool) -> list[str]:
    return ["node", "top", "below", "dist", *(["seg"] if paths else []), "done"]


def _jump(rows: DataFrame, known: DataFrame, broadcast: bool) -> DataFrame:
    """``rows`` after they took over the pointer of the row they point to; resolved rows stay as they are."""
    paths = "seg" in rows.columns
    k = known.select([F.col(c).alias(f"k_{c}") for c in _kept(paths)])
    found = F.col("k_node").isNotNull()
    ended = F.col("done") | ~found | F.col("k_done")
    return rows.join(F.broadcast(k) if broadcast else k, F.col("top") == F.col("k_node"), "left").select(
        "node",
        F.when(~ended, F.col("k_top")).alias("top"),
        F.when(found, F.col("k_below")).otherwise(F.col("below")).alias("below"),
        F.when(found, F.col("dist") + F.col("k_dist")).when(F.col("done"), F.col("dist")).otherwise(F.col("dist") - 1).alias("dist"),
        *([F.when(found, F.concat("k_seg", "seg")).otherwise(F.col("seg")).alias("seg")] if paths else []),
        ended.alias("done"),
    )


def _doubled(stage: Stage, edges: DataFrame, few: int, paths: bool) -> tuple[DataFrame, bool]:
    """(node, below, dist[, seg]) of the nodes of ``edges`` (node, top), and whether they are few: below is the root and dist the depth, '' and -1 where there is none.

    While a row is open, top is the ancestor at distance dist and below the node just under it.
    """
    start = {"below": F.col("node"), "dist": F.lit(1).cast("bigint"), "done": F.lit(False)} | ({"seg": F.array("node")} if paths else {})
    known = open_rows = stage.write(edges.withColumns(start).select(*_kept(paths)), "r0")
    left = known.count()
    if small := left <= few:
        parts = [_settled(stage, known, paths)]
    else:
        parts, n, before = [], 0, -1
        while left > few and left != before:
            n += 1
            before = left
            state = stage.write(_jump(open_rows, known, False), f"r{n}", by=["done"])
            parts.append(state.where("done"))
            open_rows = state.where("not done")
            left = open_rows.count()
            # what is pointed to now was pointed to before: it is in this state or was resolved in the table looked up
            tops = open_rows.select(F.col("top").alias("node")).distinct()
            known = stage.write(state.unionByName(known.where("done")).join(tops, "node", "left_semi"), f"known{n}")
        if left and left != before:  # few are left: what they point to is settled first
            open_rows = _jump(open_rows, _settled(stage, known, paths), not paths)
        parts.append(open_rows)
    never = lambda c, value: F.when(F.col("done"), F.col(c)).otherwise(value).alias(c)
    out = reduce(DataFrame.unionByName, [p.select(*_kept(paths)) for p in parts])
    return out.select("node", never("below", F.lit("")), never("dist", F.lit(-1)), *([never("seg", F.lit(None))] if paths else [])), small


def _settled(stage: Stage, state: DataFrame, paths: bool) -> DataFrame:
    """``state`` of few rows that point to each other, doubled twice a round until a round resolves nothing."""
    left, before, n = state.where("not done").count(), -1, 0
    while left and left != before:
        n += 1
        before, known = left, state
        for _ in range(3):  # three jumps over pointers of one length: four times that length
            state = _jump(state, known, not paths)
        state = stage.write(state, f"s{n}")
        left = state.where("not done").count()
    return state


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every proper descendant of every node of :func:`hierarchy`.

    Made from the paths without a join; its size is the sum of all depths, by definition.
    """
    return resolved.where("depth > 0").select("node_id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("at", "ancestor_id")).select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def subtree(resolved: DataFrame, node_id: str) -> DataFrame:
    """The rows of :func:`hierarchy` at or below ``node_id``."""
    return resolved.where(F.array_contains("path", node_id))
