"""One consistent form for texts that look the same but consist of different characters.

DuckDB runs inside the Arrow batches of each partition: invisible characters are removed and
blanks unified by regular expressions, letters and their marks are composed by nfc_normalize,
full-width forms and look-alike letters are mapped by translate, all in one SQL expression.
Letters with and without a mark, capitals and small letters, raised and ordinary digits, and
signs such as the number sign stay different.

Defined cases: null stays null, empty stays empty; a text of invisible characters becomes empty;
every blank, also a line break, becomes one space and runs of blanks keep their length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexcorpus.staging import Stage
from lexcorpus.tables import records, spread

#: Rows whose ids are broadcast at most.
FEW = 200_000

#: Letters of Cyrillic and Greek beside the Latin letter of the same shape (fixed values).
SAME_SHAPE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "G": "Ԍ", "Q": "Ԛ", "W": "Ԝ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
    "Ɵ": "ӨΘ", "ɵ": "ө", "ə": "ә", "Ə": "Ә", "æ": "ӕ", "Æ": "Ӕ", "Г": "Γ", "П": "Π", "Ф": "Φ", "к": "κ", "ү": "γ",
}

INVISIBLE = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{E0000}-\\x{E0FFF}]"
BLANK = "[\\t\\n\\x{000B}\\f\\r\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@cache
def letters() -> tuple[str, str]:
    """From and to of translate, as SQL literals: full-width and half-width forms, look-alikes, and look-alikes composed with a mark."""
    nfc = lambda s: unicodedata.normalize("NFC", s)
    to = {chr(c): k for c in range(0xFF01, 0xFFEF) if len(k := unicodedata.normalize("NFKC", chr(c))) == 1 and k != chr(c) and not k.isspace()}
    plain = {x: latin for latin, others in SAME_SHAPE.items() for x in others}
    to |= plain
    for mark in map(chr, range(0x0300, 0x0345)):
        for x, latin in plain.items():
            a, b = nfc(x + mark), nfc(latin + mark)
            if len(a) == len(b) == 1 and a != b:
                to.setdefault(a, b)
    for a in [k for k, v in to.items() if v in to]:
        to[a] = to[to[a]]
    keys = sorted(to)
    return "".join(keys), "".join(to[k] for k in keys).replace("'", "''")


def expression(column: str) -> str:
    """The DuckDB expression of the consistent form of ``column``."""
    a, b = letters()
    bare = f"nfc_normalize(regexp_replace(regexp_replace({column}, '{INVISIBLE}', '', 'g'), '{BLANK}', ' ', 'g'))"
    return f"nfc_normalize(translate({bare}, '{a}', '{b}'))"


def in_duckdb(df: DataFrame, sql: str, schema: str | T.StructType) -> DataFrame:
    """``sql`` over the table ``batch`` for every Arrow batch of ``df``."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        want = to_arrow_schema(schema)
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from out.cast(want).to_batches()

    return df.mapInArrow(run, schema)


def consistent(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and, of each of ``columns``, the consistent form under the same name."""
    df = spread(df.select(*keep, *columns))
    sql = "SELECT " + ", ".join([*(f'"{c}"' for c in keep), *(f'{expression(f"{chr(34)}{c}{chr(34)}")} AS "{c}"' for c in columns)]) + " FROM batch"
    return in_duckdb(df, sql, df.schema)


def disguised(nodes: DataFrame, versions: DataFrame, fields: list[str]) -> DataFrame:
    """(a_id, b_id, field_name): nodes at one locator of different versions of a document that look alike in a field but differ in its characters.

    A first pass sends every row through DuckDB and keeps two hashes a field; only groups of
    (document, locator, form) with more than one spelling go on. Their rows are few, and are
    brought to the consistent form again and compared exactly.
    """
    stage = Stage(nodes.sparkSession, "lookalikes")
    rows = spread(nodes.where("id is not null").select("id", "document_version_id", "source_locator", "updated_at", *fields))
    owners = versions.select(F.col("id").alias("document_version_id"), "document_id").distinct()
    number = lambda e: f"hash({e}) :: DECIMAL(38,0) % 9223372036854775807"
    hashes = ", ".join(f"CASE WHEN {f} <> '' THEN {number(expression(f))} END AS form_{f}, CASE WHEN {f} <> '' THEN {number(f)} END AS raw_{f}" for f in fields)
    schema = T.StructType([rows.schema[c] for c in ("id", "document_version_id", "source_locator", "updated_at")])
    for f in fields:
        schema = schema.add(f"form_{f}", T.LongType()).add(f"raw_{f}", T.LongType())
    hashed = in_duckdb(rows, f"SELECT id, document_version_id, source_locator, updated_at, {hashes} FROM batch", schema)
    # of repeated rows the one updated last counts; only hashes are shuffled for that
    ends = [f"{x}_{f}" for f in fields for x in ("form", "raw")]
    once = records(hashed, "id", ["document_version_id", "source_locator", *ends], ["updated_at"]).join(owners, "document_version_id")
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"form_{f}").alias("form"), F.col(f"raw_{f}").alias("raw")) for f in fields])
    long = stage.write(once.where("source_locator is not null").select("id", "document_version_id", "document_id", "source_locator", F.inline(F.filter(each, lambda x: x["form"].isNotNull()))), "hashed")
    group = ["document_id", "source_locator", "field_name", "form"]
    mixed = long.groupBy(*group).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*group)
    alike = stage.write(long.join(mixed, group, "left_semi"), "alike")
    ids = alike.select("id").distinct()
    if alike.count() <= FEW:  # the table is then reduced where it is read
        ids = F.broadcast(ids)
    texts = rows.join(ids, "id", "left_semi").select("id", *fields)
    forms = ", ".join(f"{f}, {expression(f)} AS form_{f}, {number(f)} AS raw_{f}" for f in fields)
    schema = T.StructType([texts.schema["id"]])
    for f in fields:
        schema = schema.add(f, T.StringType()).add(f"form_{f}", T.StringType()).add(f"raw_{f}", T.LongType())
    formed = in_duckdb(texts, f"SELECT id, {forms} FROM batch", schema)
    spelled = formed.select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw_text"), F.col(f"form_{f}").alias("form_text"), F.col(f"raw_{f}").alias("raw")) for f in fields]))).distinct()
    spelled = alike.join(spelled, ["id", "field_name", "raw"])
    a, b = spelled.alias("a"), spelled.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*group, "form_text"]]
    differ = [F.col("a.id") < F.col("b.id"), F.col("a.document_version_id") != F.col("b.document_version_id"), F.col("a.raw_text") != F.col("b.raw_text")]
    return a.join(b, [*same, *differ]).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.col("a.field_name").alias("field_name")).distinct()
