import lexcorpus.operators.retrieval as R

PUBLIC = "citation_key string, locator string, legal_node_id string, document_version_id string, exact_text string, document_id string, node_type string, article string, paragraph string, node_title string"
ASKED = "candidate_id string, query string, node_id string, locator string, document_id string, citation_key string"
DOCUMENTS = "id string, title string, updated_at timestamp_ntz"


def shuffled(spark, before=0):
    """Records that all shuffles so far have written, less ``before``."""
    store, plans = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(plans, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), plans)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size())) - before


def acts(n):
    """Of each act article 1 with its paragraph 1; every third article is cited twice."""
    rows = [(f"{i}:art-1", "art-1", f"a{i}", f"v{i}", f"text {i}", f"d{i}", "ARTICLE", "1", None, None) for i in range(n)]
    rows += [(f"{i}:art-1/p-1", "art-1/p-1", f"p{i}", f"v{i}", "x", f"d{i}", "PARAGRAPH", "1", "1", "Title") for i in range(n)]
    return rows + [(f"again {i}", "art-1", f"a{i}", f"v{i}", f"text {i}", f"d{i}", "ARTICLE", "1", None, None) for i in range(0, n, 3)]


def documents(spark, n):
    return spark.createDataFrame([(f"d{i}", f"Act {'even' if i % 2 == 0 else 'odd'} {i}", None) for i in range(n)], DOCUMENTS)


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 5000)
    n = 300
    asked = [(f"l{i}", "art-1", None, None, None, None) for i in range(n)] + [(f"k{i}", f"{i}:art-1.1", None, None, None, None) for i in range(n)]
    began = shuffled(spark)
    got = R.retrieve_batch(spark.createDataFrame(asked, ASKED), spark.createDataFrame(acts(n), PUBLIC), documents(spark, n))
    rows = [tuple(r) for r in got.select("candidate_id", "legal_node_id", "title", "excerpt").collect()]
    moved = shuffled(spark, began)
    assert len(rows) == 2 * n * n and set(rows) == {(f"l{c}", f"a{i}", "art-1", f"text {i}") for c in range(n) for i in range(n)} | {(f"k{c}", f"p{i}", "Title", "x") for c in range(n) for i in range(n)}
    assert 0 < moved < 2 * n * n / 5


def test_every_pair_once(spark, monkeypatch):
    n, law = 12, " хуулийн 1 дүгээр зүйл"
    asked = [
        ("way", "art-1", "a3", "art-1", None, "5:art-1"), ("way", "art-1", "a3", "art-1", None, "5:art-1"), ("two", "art-1", None, None, "d1", None), ("two", "art-1/p-1", None, "art-1", "d2", None), ("two", "again 3", "p4", "art-1", None, None),
        ("hint", "even" + law, None, None, None, None), ("hint", "ODD 1" + law, None, None, None, None), ("both", "odd" + law, "a2", None, "d3", "3:art-1"), ("dot", "7:art-1.1", None, None, None, None), ("none", "?", None, None, None, None),
        (None, "art-1", None, None, None, None), (None, "2:art-1", "p1", None, None, None), ("elsewhere", "art-1", None, None, "gone", None), ("no act", "газрын" + law, None, "art-1", None, None),
    ]
    candidates, public, docs = spark.createDataFrame(asked, ASKED), spark.createDataFrame(acts(n), PUBLIC), documents(spark, n)
    titles = {r.id: r.title.lower() for r in docs.collect()}
    fits = lambda a, p: (a.way, a.key) == (p.way, p.key) and a.document_id in (None, p.document_id) and (a.hint is None or a.hint.lower() in titles[p.document_id])
    named = R._named(public).collect()
    want = {(a.candidate_id, p.document_version_id, p.legal_node_id) for a in R._asked(candidates).collect() for p in named if fits(a, p)}
    assert {c for c, *_ in want} == {"way", "two", "hint", "both", "dot", None}
    for part, many in ((4, 100), (R.PART, 100), (4, 1)):  # cut into parts, whole, made distinct
        monkeypatch.setattr(R, "PART", part)
        monkeypatch.setattr(R, "MANY", many)
        got = [tuple(r) for r in R.find(candidates, public, docs).collect()]
        assert len(got) == len(want) and set(got) == want
