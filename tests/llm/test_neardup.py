import itertools
import random
import re

import pytest

import lexcorpus.llm.neardup as N
from lexcorpus.llm.neardup import NearDuplicates, Similar, groups, pairs_across_documents, word_rows

SCHEMA = "id string, doc string, text string, words int, cls string"


def brute(rows, s):
    sets = {}
    for i, doc, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= s.min_words:
            sets[i] = (doc, tuple(w), {tuple(w[k : k + s.words]) for k in range(len(w) - s.words + 1)})
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x[0] and y[0] and x[0] != y[0] and len(x[2] & y[2]) / len(x[2] | y[2]) >= s.threshold:
            out.add((a, b))
    return out


def texts(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"үг{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(22, 60))]
        rows.append((f"r{i:04}", f"d{i % 23}", " ".join(w)))
        for k in range(rng.randint(0, 3)):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            if rng.random() < 0.3:
                v.insert(rng.randrange(len(v)), rng.choice(vocab))
            rows.append((f"r{i:04}-{k}", f"d{rng.randint(0, 40)}", ", ".join(v).upper()))
    return rows + [("null", "d1", None), ("empty", "d1", ""), ("short", "d2", "a b c"), ("nodoc", None, rows[0][2]), rows[0]]


def made(spark, rows, s):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    return NearDuplicates(word_rows(df, "id", "text", s.min_words, ["doc"]).dropDuplicates(["id"]), s)


LOW = Similar(words=3, threshold=0.5, bands=44)


@pytest.mark.parametrize("s, block", [(LOW, 500), (Similar(), 500), (LOW, 2), (Similar(), 2)])
def test_pairs_equal_brute_force(spark, monkeypatch, s, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = texts(120)
    want = brute(rows, s)
    got = {tuple(r) for r in pairs_across_documents(made(spark, rows, s)).collect()}
    assert not got - want
    assert len(want & got) >= 0.98 * len(want) and want


def test_groups(spark):
    s = LOW
    base = [f"w{i}" for i in range(40)]
    rows = []
    for k in range(6):  # a chain: each differs from the one before by three words
        base = [*base[:k * 3], *(f"x{k}{j}" for j in range(3)), *base[k * 3 + 3 :]]
        rows += [(f"a{k}", f"d{k}", " ".join(base)), (f"b{k}", f"e{k}", " ".join(base))]
    rows.append(("alone", "d", " ".join(f"q{i}" for i in range(30))))
    got = {r.id: r for r in groups(made(spark, rows, s)).collect()}
    assert len({got[f"a{k}"].group_id for k in range(6)}) == 1 and got["alone"].n_links == 0
    assert all(got[f"a{k}"].class_id == got[f"b{k}"].class_id for k in range(6)) and got["alone"].group_id not in {got["a0"].group_id}
    assert groups(made(spark, [], s)).count() == 0


def test_sequential_limits():
    for s in (Similar(), LOW):
        steps = s.least_matches()
        assert steps[-1][0] <= s.size and all(m <= s.threshold * n for n, m in steps) and all(a[1] <= b[1] for a, b in zip(steps, steps[1:]))
        assert (1 - s.threshold**s.rows) ** s.bands <= 0.005


def test_phrase_common_to_all(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 20)
    rng = random.Random(3)
    phrase = [f"хэсэг{i}" for i in range(24)]
    rows = []
    for i in range(150):  # two fifths of each text are the phrase; every tenth has a near copy
        own = [f"{rng.choice('абвгд')}{rng.randrange(10**6)}" for _ in range(36)]
        rows.append((f"t{i:03}", f"d{i}", " ".join(phrase + own)))
        if i % 10 == 0:
            rows.append((f"u{i:03}", f"e{i}", " ".join(phrase + own[:30] + ["x", "y"])))
    found = made(spark, rows, LOW)
    assert {tuple(r) for r in pairs_across_documents(found).collect()} == brute(rows, LOW)
    met = N._met(spark.createDataFrame([("k", i, 90) for i in range(90)], "key string, rep bigint, n bigint"), "key").collect()
    assert len(met) == 90 * 89 // 2 == len(set(met)) and all(a < b for a, b in met)
