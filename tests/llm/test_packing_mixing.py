import random
from collections import Counter

import numpy as np
import pytest

from lexcorpus.llm.mixing import goals, mix, shares
from lexcorpus.llm.packing import fill, pack, plan
from lexcorpus.llm.tokens import ranked, sized


def best_fit(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        i = min((i for i, r in enumerate(room) if r >= x), key=room.__getitem__, default=None)
        if i is None:
            room.append(capacity - x)
        else:
            room[i] -= x
    return len(room)


@pytest.mark.parametrize("capacity, seed", [(1, 1), (2, 1), (7, 2), (64, 3), (256, 4), (1000, 5)])
def test_plan_uses_every_item_once_within_capacity(capacity, seed):
    rng = random.Random(seed)
    for n in (0, 1, 5, 400):
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, dtype=int)
        out = plan(counts, capacity)
        used = Counter()
        for m, items in out:
            assert m > 0 and sum(items) <= capacity
            for x in items:
                used[x] += m
        assert used == Counter(lengths)
        assert sum(m for m, _ in out) <= 1.01 * best_fit(lengths, capacity) + 1


def test_pack(spark):
    texts = [(1, None), (2, ""), (3, "one"), (4, "word " * 700), (5, "x y z"), (5000, "a b c d e f g h"), *((10 + i, "шүүх хууль " * (i % 9 + 1)) for i in range(60))]
    df = spark.createDataFrame([(i, t, 7, "p") for i, t in texts], "doc_id bigint, text string, piece int, pid string")
    caps = spark.createDataFrame([(1, "a", 16), (2, "b", 256)], "capacity_id int, purpose string, capacity_tokens bigint")
    rows = pack(df, caps).collect()
    n = {r.doc_id: r.n_tokens for r in sized(df, "text", ["doc_id"]).collect()}
    for c, size in ((1, 16), (2, 256)):
        mine = [r for r in rows if r.capacity_id == c]
        assert {r.doc_id for r in mine} == set(n)
        load = Counter()
        for r in mine:
            if r.container_id is None:
                assert n[r.doc_id] == 0
            else:
                load[r.container_id] += r.n_tokens
        assert max(load.values()) <= size and set(load) == set(range(len(load)))
        for d, k in n.items():
            ps = sorted((r.start_token, r.n_tokens) for r in mine if r.doc_id == d)
            assert sum(x for _, x in ps) == k and (len(ps) == 1 or k > size) and all(a + x == b for (a, x), (b, _) in zip(ps, ps[1:]))
    assert all(0 < r.fill <= 1 for r in fill(pack(df, caps), caps).collect())
    assert pack(df.limit(0), caps).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", i % 4) for i in range(200)], "i int, g string, pid int")
    rows = ranked(df, ["g"], ["i"]).collect()
    for g in ("hot", "cold"):
        mine = sorted(r.rank for r in rows if r.g == g)
        assert mine == list(range(len(mine)))


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, "хууль " * rng.randint(1, 90) + str(i), rng.choice(["a", " A", "b", "c "])) for i in range(900)] + [(2000 + i, "same text", "a") for i in range(50)] + [(3000, None, "a"), (3001, "", "b"), (3002, "x", None), (3003, "x", "unknown")]
    df = spark.createDataFrame([(*d, 3, 1) for d in docs], "doc_id bigint, text string, source string, n_tokens int, share int")
    targets = spark.createDataFrame([("A", 0.6, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.0001, 2)], "source string, target_share double, max_repeats int")
    chosen = mix(df, targets).collect()
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.copies <= caps[r.source] for r in chosen) and sum(r.doc_id >= 2000 for r in chosen) <= 1 and len({r.doc_id for r in chosen}) == len(chosen)
    longest = {s: max(r.n_tokens for r in sized(df.where("trim(lower(source)) = '" + s + "'"), "text", ["doc_id"]).collect()) for s in caps}
    report = {r.source: r for r in shares(mix(df, targets), targets).collect()}
    assert all(abs(report[s].n_tokens - report[s].goal_tokens) < longest[s] for s in caps)
    assert report["none"].actual_share == 0.0 and report["none"].n_texts == 0
    # a small total is reached by all sources: each gives its share
    small = {r.source: r for r in shares(mix(df, targets, total_tokens=50000), targets).collect()}
    assert all(abs(small[s].n_tokens - w * 50000) < longest[s] for s, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    # more than all sources have: everything, as often as allowed
    most = {r.doc_id: (r.source, r.copies) for r in mix(df, targets, total_tokens=10**9).collect()}
    assert all(c == caps[s] for s, c in most.values()) and len(most) == 901
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets, total_tokens=0).count() == 0


def test_goals_fill_up_after_small_sources():
    got = goals({"tiny": (0.5, 2, 100), "small": (0.2, 3, 500), "large": (0.3, 1, 10000)}, 4000)
    assert got == {"tiny": 200.0, "small": 1500.0, "large": 2300.0}
    assert goals({"a": (0.5, 1, 100), "b": (0.5, 1, 100)}, 100) == {"a": 50.0, "b": 50.0} and goals({"a": (1.0, 2, 10)}, 100) == {"a": 20.0} and goals({}, 5) == {}
