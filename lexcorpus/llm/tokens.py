"""Sizes of texts in tokens of a public tokenizer, and ranks without unbounded groups."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; every function takes another as a parameter.
VOCABULARIES = os.environ.get("LEXCORPUS_TOKENIZERS", "/opt/tokenizers")
DEFAULT = f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken"

#: How the rank files split a text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(vocabulary: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = DEFAULT) -> DataFrame:
    """``keep`` and n_tokens of every row; null and empty texts have no tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    src = df.select(*keep, F.col(text_col).alias("__text"))
    schema = StructType(list(src.schema)[:-1]).add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, want = _encoder(vocabulary).encode_ordinary, to_arrow_schema(schema)
        for b in batches:
            n = pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(want.field(i).type) for i in range(b.num_columns - 1)], n], schema=want)

    return src.mapInArrow(run, schema)


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` (with a fixed column pid) and rank, from 0 within ``group``.

    Rows are numbered within (group, pid) and shifted by the counts of the partitions before: no
    window holds more rows than a partition had, however large a group is.
    """
    counts = df.groupBy(*group, "pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy(*group, "pid").orderBy(*order)
    return df.withColumn("at", F.row_number().over(inside) - 1).join(shift, [*group, "pid"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "shift")
