"""Sources mixed to target weights by systematic sampling.

Equal texts are one text: it belongs to the source of its smallest id, so that no text is used
more often than its source allows. A source that can't give its share of the total even when all
its texts are used ``max_repeats`` times gives just that; what it lacks is spread over the others in
proportion to their shares. The total is that of all texts of the target sources, or
``total_tokens``; where every source is used up before it is reached, the mix is that much smaller.
:func:`shares` reports the goal and the share reached of each source, so any of this shows.

Within a source every text has the same expected number of copies, goal over size; their prefix
sums plus one random offset of the source are cut at the integers, and a text is emitted once for every
integer crossed. The prefix sums run over the texts in order of size, so the tokens of a source
differ from its goal by less than its longest text.

Scale: ranges of (source, size, id) make the partitions, their number follows the number of rows,
and ranks come from partition counts, so a source with a third of all texts is spread over many
tasks.

Defined cases: sources compare without surrounding blanks and case; texts without a target source
or without tokens aren't chosen; a source without texts is reported with share 0; a total of zero or
less and empty tables give no texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexcorpus.llm.tokens import DEFAULT, ranked, sized
from lexcorpus.operators.scan import n_ranges
from lexcorpus.staging import Stage
from lexcorpus.tables import spread, stripped


def goals(sources: dict[str, tuple[float, int, int]], total: float) -> dict[str, float]:
    """Tokens each source is to give, of {source: (share, cap, tokens)}: its share of ``total``, at most cap * tokens, the rest from the others in proportion."""
    out: dict[str, float] = {}
    rest = dict(sources)
    while rest:
        left, whole = max(0.0, total - sum(out.values())), sum(share for share, _, _ in rest.values())
        full = [s for s, (share, cap, n) in rest.items() if share / whole * left >= cap * n]
        if not full:
            return out | {s: share / whole * left for s, (share, _, _) in rest.items()}
        for s in full:
            _, cap, n = rest.pop(s)
            out[s] = float(cap * n)
    return out


def _targets(targets: DataFrame) -> DataFrame:
    """(source, share, cap), a row for each source as compared."""
    return targets.groupBy(F.lower(stripped(F.col("source"))).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))


def mix(df: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, vocabulary: str = DEFAULT) -> DataFrame:
    """(doc_id, source, n_tokens, copies, goal_tokens) of every chosen text.

    ``targets`` (source, target_share, max_repeats) is a parameter table of a few rows.
    """
    spark = df.sparkSession
    stage = Stage(spark, "mixing")
    wanted = F.broadcast(_targets(targets).where("share > 0 and cap > 0"))
    texts = spread(df.select("doc_id", F.lower(stripped(F.col("source"))).alias("source"), "text").where("text is not null")).join(wanted.select("source"), "source", "left_semi")
    texts = sized(texts.withColumn("same", F.md5("text")), "text", ["doc_id", "source", "same"], vocabulary).where("n_tokens > 0")
    one = texts.groupBy("same").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("t")).select("t.*")
    one = stage.write(one, "texts")
    size = one.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n")).join(wanted, "source")
    # one row for each target at most
    there = size.collect()
    sources = {r["source"]: (r["share"], r["cap"], r["size"]) for r in there}
    goal = goals(sources, float(sum(n for _, _, n in sources.values()) if total_tokens is None else total_tokens))
    rates = [(s, sources[s][1], g, g / sources[s][2]) for s, g in goal.items() if g > 0]
    rows = one.repartitionByRange(n_ranges(spark, sum(r["n"] for r in there)), "source", "n_tokens", "doc_id").withColumn("pid", F.spark_partition_id())
    rate = spark.createDataFrame(rates, "source string, cap bigint, goal_tokens double, c double")
    at = ranked(stage.write(rows, "ranges"), ["source"], ["n_tokens", "doc_id"]).join(F.broadcast(rate), "source")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(offset + F.col("c") * (F.col("rank") + 1)) - F.floor(offset + F.col("c") * F.col("rank"))
    return at.select("doc_id", "source", "n_tokens", F.least(copies, "cap").alias("copies"), "goal_tokens").where("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_texts, most_copies, n_tokens, goal_tokens, actual_share) of :func:`mix`."""
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("goal_tokens").alias("goal_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # a window over the targets: a few rows
    t = _targets(targets).join(F.broadcast(got), "source", "left").withColumn("whole", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    return t.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), zero("n_texts"), zero("most_copies"), zero("n_tokens"), zero("goal_tokens"), F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
