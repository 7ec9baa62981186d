import random
from datetime import datetime as D
from datetime import timedelta as T

from lexcorpus.operators.intervals import IntervalMap, periods, periods_stream

SCHEMA = "doc string, a timestamp_ntz, b timestamp_ntz, entity string, pid int"


def brute(rows):
    out = set()
    for doc in {r[0] for r in rows if r[0] is not None}:
        ivs = sorted((a, b) for d, a, b in rows if d == doc and a and b and a < b)
        merged = []
        for a, b in ivs:
            if merged and a <= merged[-1][1] + T(seconds=1):
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(doc, "period", a, b) for a, b in merged} | {(doc, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows):
    return {tuple(r) for r in periods(spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA), "doc", "a", "b").collect()}


def test_map_merges_in_any_order():
    rng = random.Random(1)
    for _ in range(200):
        ivs = [(a := rng.randint(0, 60), a + rng.randint(1, 12)) for _ in range(rng.randint(0, 12))]
        m = IntervalMap(slack=1)
        for a, b in ivs:
            m.insert(a, b)
        want = []
        for a, b in sorted(ivs):
            if want and a <= want[-1][1] + 1:
                want[-1] = (want[-1][0], max(want[-1][1], b))
            else:
                want.append((a, b))
        assert list(zip(m.starts, m.ends)) == want
        assert m.gaps() == [(x[1], y[0]) for x, y in zip(want, want[1:])]


def test_cases(spark):
    d = D(2020, 1, 1)
    rows = [("x", d, d + T(days=9)), ("x", d + T(days=2), d + T(days=3)), ("x", d + T(days=9, seconds=1), d + T(days=12)), ("x", d + T(days=12, seconds=2), d + T(days=14)), ("x", d, d + T(days=9)), ("x", None, d), ("x", d, None), ("x", d, d), ("x", d + T(1), d), (None, d, d + T(1))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set()


def test_an_entity_over_many_partitions(spark):
    rng, d = random.Random(5), D(2000, 1, 1)
    for span in (3, 40, 4000):
        rows = [("hot" if i % 3 else f"d{i % 7}", s := d + T(hours=rng.randint(0, 9000)), s + T(hours=rng.randint(1, span))) for i in range(600)]
        assert run(spark, rows) == brute(rows)


def test_stream_has_the_same_periods(spark, tmp_path):
    rng, d = random.Random(6), D(2000, 1, 1)
    rows = [(f"d{i % 4}", s := d + T(hours=rng.randint(0, 900)), s + T(hours=rng.randint(1, 30)), "e", 1) for i in range(80)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = periods_stream(s, "doc", "a", "b").writeStream.format("memory").queryName("iv").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    rows_of = lambda alive: {(r.entity, r.kind, r.start_us, r.end_us) for r in spark.table("iv").where("alive" if alive else "not alive").collect()}
    us = lambda t: int((t - D(1970, 1, 1)).total_seconds()) * 1_000_000
    batch = {(a, b, us(c), us(e)) for a, b, c, e in run(spark, [r[:3] for r in rows])}
    assert batch == {(a, b, us(c), us(e)) for a, b, c, e in brute([r[:3] for r in rows])} == rows_of(True) - rows_of(False)
    assert rows_of(False)
