import random

from lexcorpus.operators.hierarchy import descendants, hierarchy, subtree

NODES = "id string, parent_id string, updated_at int, node string, k string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, p, u, "x", "y") for i, p, u in rows], NODES)
    return {r.node_id: (r.root_id, r.depth, r.path) for r in hierarchy(df, newest=["updated_at"], **kw).collect()}


def brute(parents):
    out = {}
    for n in parents:
        path, seen, at = [n], {n}, n
        while True:
            p = parents[at]
            if p is None or p not in parents:
                out[n] = (at, len(path) - 1, path[::-1])
                break
            if p in seen:
                out[n] = ("", -1, None)
                break
            path.append(p)
            seen.add(p)
            at = p
    return out


def test_cases(spark):
    rows = [("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("o", "gone", 1), ("p", "o", 1), ("s", "s", 1), ("t", "s", 1), ("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("w", "z", 1), (None, "a", 1)]
    got = run(spark, rows)
    assert got["a"] == ("a", 0, ["a"]) and got["c"] == ("a", 2, ["a", "b", "c"])
    assert got["o"] == ("o", 0, ["o"]) and got["p"] == ("o", 1, ["o", "p"])
    assert all(got[n] == ("", -1, None) for n in "stxyzw") and None not in got


def test_repeated_rows_keep_the_latest(spark):
    assert run(spark, [("a", None, 1), ("b", None, 1), ("c", "a", 1), ("c", "a", 1), ("c", "b", 2)])["c"][0] == "b"


def test_empty(spark):
    assert run(spark, []) == {}


def test_deep_chain_and_random_forests(spark):
    chain = {f"n{i:03}": f"n{i - 1:03}" if i else None for i in range(150)}
    assert run(spark, [(n, p, 1) for n, p in chain.items()]) == brute(chain)
    rng = random.Random(3)
    for few in (0, 12, 10**6):
        parents = {f"n{i}": rng.choice([None, "gone", *(f"n{j}" for j in range(60))]) if rng.random() < 0.3 else f"n{max(0, i - rng.randint(1, 3))}" for i in range(60)}
        assert run(spark, [(n, p, 1) for n, p in parents.items()], few=few) == brute(parents)
        df = spark.createDataFrame(list(parents.items()), "id string, parent_id string")
        assert {tuple(r) for r in hierarchy(df, few=few, paths=False).collect()} == {(n, r, d) for n, (r, d, _) in brute(parents).items()}


def test_descendants_and_subtree(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("q", None)], "id string, parent_id string")
    h = hierarchy(df)
    assert sorted(tuple(r) for r in descendants(h).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert {r.node_id for r in subtree(h, "b").collect()} == {"b", "c"}
