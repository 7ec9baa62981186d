import os
from datetime import datetime as D

import pytest

from lexcorpus.api import Corpus, Request, clamp_limit, retrieve, verify
from lexcorpus.operators import audit, ingest
from lexcorpus.sources import archive, listing, snapshot
from lexcorpus.streaming import pipelines

NODE = "id string, document_version_id string, parent_id string, node_type string, chapter string, article string, paragraph string, title string, text string, source_locator string, content_hash string, updated_at timestamp_ntz"
VERSION = "id string, document_id string, version_number int, effective_from timestamp_ntz, effective_to timestamp_ntz, content_hash string, parser_id string, status string, archive_record_id string, amendment_document_id string"
T = D(2020, 1, 1)


def node(i, v, parent, kind, locator, title=None, text="x", article=None, paragraph=None):
    return (i, v, parent, kind, None, article, paragraph, title, text, locator, "h", T)


@pytest.fixture(scope="module")
def corpus(spark):
    nodes = spark.createDataFrame(
        [
            node("r1", "v1", None, "DOCUMENT", "doc"), node("n1", "v1", "r1", "ARTICLE", "art-1", "Ажлаас халах эрх", "Ажлаас үндэслэлгүй халах", "1"), node("r2", "v2", None, "DOCUMENT", "doc"), node("n2", "v2", "r2", "ARTICLE", "art-1", "Ажлаас халах эрх", "Шинэ", "1"),
            node("r3", "v3", None, "DOCUMENT", "doc"), node("n3", "v3", "r3", "ARTICLE", "art-1", None, "бусад", "1"), node("bad", "v3", "gone", "CLAUSE", "art-1", None, "бусад"),
        ],
        NODE,
    )
    versions = spark.createDataFrame([("v1", "d1", 1, D(2015, 1, 1), D(2020, 1, 1), "a", "p", "SUPERSEDED", "x", None), ("v2", "d1", 2, D(2020, 1, 1), None, "b", "p", "PUBLISHED", "x", "d2"), ("v3", "d2", 1, None, None, "c", "p", "PUBLISHED", "x", None)], VERSION)
    documents = spark.createDataFrame([("d1", "Хөдөлмөрийн хууль", "12", "https://a.example/mn/detail?lawId=7", T, "LAW"), ("d2", "Бусад", None, "https://a.example/x", T, "LAW")], "id string, title string, document_number string, canonical_url string, updated_at timestamp_ntz, document_type string")
    citations = spark.createDataFrame([("c1", "v1", "n1", "7:art-1", "art-1", "t", "h", "VALID"), ("c2", "v2", "n2", "7:art-1", "art-1", "t", "h", "VALID"), ("c3", "v3", "n3", "key", "art-1", "t", "h", "VALID")], "id string, document_version_id string, legal_node_id string, citation_key string, locator string, exact_text string, content_hash string, status string")
    return Corpus(nodes, versions, documents, citations)


def verdicts(spark, corpus, rows, as_of=None):
    schema = "candidate_id string, query string, node_id string, locator string, document_id string, citation_key string"
    return {r.candidate_id: (r.verdict, r.legal_node_id, r.reasons) for r in verify(corpus, spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], schema), as_of).collect()}


def test_verify(spark, corpus):
    rows = [("a", "7:art-1", None, None), ("b", "missing", None, None), ("c", None, None, "art-1"), ("d", None, "n3", None), ("e", None, None, None), ("f", " 1 дүгээр зүйл ", None, None)]
    got = verdicts(spark, corpus, rows)
    assert got["a"] == ("VALID", "n2", ["citation_unique"]) and got["b"] == ("UNRESOLVED", None, ["citation_unresolved"]) and got["c"] == ("CONFLICT", None, ["citation_conflict"])
    assert got["d"][1] == "n3" and got["e"][0] == "UNRESOLVED" and got["f"][0] == "CONFLICT"
    assert verdicts(spark, corpus, rows[:2], "2016-01-01") == {"a": ("VALID", "n1", ["citation_unique"]), "b": ("UNRESOLVED", None, ["citation_unresolved", "as_of_unavailable"])}


def test_verify_two_acts_with_the_same_article(spark, corpus):
    rows = [
        ("act", "ХӨДӨЛМӨРИЙН хуулийн 1 дүгээр зүйл", None, None), ("part", "лмөри  хуулийн 1 дүгээр зүйл", None, None), ("short", "Бу хуулийн 1 дүгээр зүйл", None, None), ("none", "Газрын хуулийн 1 дүгээр зүйл", None, None), ("no-law", "Хөдөлмөр 1 дүгээр зүйл", None, None),
        ("doc", "1 дүгээр зүйл", None, None, "d2"), ("both", "Хөдөлмөрийн хуулийн 1 дүгээр зүйл", None, None, "d2"), ("own", "Хөдөлмөрийн хуулийн 9 дүгээр зүйл", None, "art-1"), ("own-first", "Хөдөлмөрийн хуулийн 1.1 дүгээр зүйл", None, "art-7"),
        ("key", "?", None, None, None, "7:art-1"), ("node-elsewhere", "?", "n3", None, "d1"), ("blank-key", "7:art-1 ", None, None),
    ]
    got = {k: v[:2] for k, v in verdicts(spark, corpus, rows).items()}
    assert got == {
        "act": ("VALID", "n2"), "part": ("VALID", "n2"), "short": ("VALID", "n3"), "none": ("UNRESOLVED", None), "no-law": ("CONFLICT", None), "doc": ("VALID", "n3"), "both": ("UNRESOLVED", None), "own": ("VALID", "n2"), "own-first": ("UNRESOLVED", None),
        "key": ("VALID", "n2"), "node-elsewhere": ("UNRESOLVED", None), "blank-key": ("UNRESOLVED", None),
    }


def test_retrieve(spark, corpus):
    def ids(**kw):
        rows, status = retrieve(corpus, Request(**kw))
        return [r.node_id for r in rows.collect()], status

    assert ids(node_id="n1", question="ignored") == (["n1"], "ok")
    assert sorted(ids(document_id="d1")[0]) == ["n2", "r2"] and sorted(ids(document_id="d1", as_of="2016-01-01")[0]) == ["n1", "r1"]
    assert ids(citation_key="7:art-1") == (["n2"], "ok") and ids(citations=("7:art-1", "7:art-1", "key"))[0] == ["n2", "n2", "n3"]
    assert ids(citation_key="Хөдөлмөрийн хуулийн 1 дүгээр зүйл")[0] == ["n2"] and ids(citations=("Бусад хуулийн 1 дүгээр зүйл", ("?", "n2")))[0] == ["n3", "n2"]
    assert ids(question="Намайг ажлаас үндэслэлгүй халах")[0] == ["n2"] and ids(question="quantum zzqqxx") == ([], "ok") and ids(question="  ") == ([], "ok")
    assert ids(question="ажлаас халах эрх", as_of="2017-01-01")[0] == ["n1"] and ids(citation_key="key", as_of="2017-01-01") == ([], "AS_OF_UNAVAILABLE")
    assert retrieve(corpus, Request(node_id="n3"))[0].first().title == "Article 1"
    for bad in ({"citations": ("x",) * 51}, {"question": "x" * 8001}, {"question": ""}, {"citations": ("x", "")}):
        with pytest.raises(ValueError):
            Request(**bad)
    assert clamp_limit(0, 0, 5) == 1 and clamp_limit(9, 0, 5) == 5


def test_structure_and_gate(spark, corpus):
    got = {r.document_version_id: r for r in audit.version_structure(corpus.nodes).collect()}
    assert got["v1"].result == "PASS" and (got["v3"].result, got["v3"].orphans, got["v3"].duplicate_locators) == ("FAIL", 1, 1)
    hashes = spark.createDataFrame([("v2", "a", "a"), ("v3", "a", "b")], "document_version_id string, archive_sha256 string, bytes_sha256 string")
    reasons = {r.document_version_id: r.reasons for r in ingest.gate_reasons(corpus.nodes, corpus.versions, corpus.documents, hashes).collect()}
    assert reasons["v2"] == "" and reasons["v1"] == "unsafe_effective_to"
    assert reasons["v3"] == "broken_article_hierarchy,duplicate_locators,archive_hash_mismatch,orphan_nodes,invalid_parent_relationships,duplicate_citation_locators"
    odd = spark.createDataFrame([node("r", "w", None, "DOCUMENT", "doc"), node("a", "w", "r", "ARTICLE", "article-1", text=" Сонсох / сонгосон хэсэг", article="0"), node("s", "w", "r", "SECTION", "sec-1", text=" ")], NODE)
    parts = {(r.document_id, r.document_version_id): r.reasons for r in ingest.confidence(odd, spark.createDataFrame([("w", "d2", 1, None, None, "c", "p", "DRAFT", "x", None)], VERSION), corpus.documents).collect()}
    assert parts == {("d1", None): "missing_version", ("d2", "w"): "malformed_numbering"}
    gate = ingest.gate_reasons(odd, corpus.versions.where("false"), corpus.documents).first().reasons
    assert gate == "missing_title,missing_act_type,malformed_numbering,invented_locator,invented_structural_level,chrome_or_toc_node"
    rules = spark.createDataFrame([("7", "no_annex", "most", "ANNEX", 0), ("7", "two_articles", "least", "ARTICLE", 2), ("7", "inserted", "locator", r"^art-1\^1$", 0), ("7", "said", "text", "Сонсох", 0), ("8", "x", "text", "x", 0)], "law_id string, reason string, check string, argument string, n int")
    from pyspark.sql import functions as F

    broken = ingest.rule_reasons(audit.nodes_once(odd.drop("paragraph")).withColumn("law_id", F.lit("7")), rules)
    assert {r.reason for r in broken.collect()} == {"two_articles", "inserted"}
    trip = {(r.citation_id, r.reason) for r in audit.citation_round_trip(corpus.citations, corpus.nodes).collect()}
    assert trip == set()


def test_locators(spark):
    schema = "id string, document_id string, article_number string, title string, text string, ord int"
    rows = [("a", "d", "180", None, "", 0), ("winner", "d", "181", None, "", 1), ("loser", "d", "181", None, "x", 2), ("n", "d", None, None, "", 7), ("e", "d", "", None, "", 8)]
    want = {"a": "article-180", "winner": "article-181", "loser": "article-181__legacyId-loser", "n": "article-7", "e": "article-"}
    for order in (rows, rows[::-1] + rows):
        assert {r.id: r.source_locator for r in audit.assign_locators(spark.createDataFrame(order, schema)).collect()} == want
    assert [(r.article_number, r.excess, r.same_text) for r in audit.locator_collisions(spark.createDataFrame(rows, schema)).collect()] == [("181", 1, False)]


def test_write_paths(spark):
    base = spark.createDataFrame([("a", "1", T), ("b", "1", T)], "id string, v string, at timestamp_ntz")
    new = spark.createDataFrame([("b", "2", T), ("b", "3", D(2021, 1, 1)), ("c", "2", T)], base.schema)
    assert {r.id: r.v for r in ingest.upsert(base, new, "id", ["at"]).collect()} == {"a": "1", "b": "3", "c": "2"}
    assert sorted(r.v for r in ingest.insert_missing(base, new, ["id"]).collect()) == ["1", "1", "2"]
    assert ingest.put_if_absent(spark.createDataFrame([(2, "x"), (1, "x"), (3, ""), (4, None)], "k int, t string"), "k", "t").select("first_key", "n_payloads").collect() == [(1, 2)]
    known = spark.createDataFrame([("a", "s1"), ("b", "s1"), (None, "s1")], "k string, s string")
    got = ingest.classify(spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s1"), (None, "s1")], "k string, s string"), known, ["k"], "s")
    assert {r.k: r.outcome for r in got.collect()} == {"a": "duplicate", "b": "updated", "c": "inserted", None: "duplicate"}


def test_null_keys_shared_targets_and_repeats(spark):
    base = spark.createDataFrame([("a", None), ("b", "k")], "id string, k string")
    rows = spark.createDataFrame([("c", None), ("d", "k"), ("e", "n")], base.schema)
    assert {r.id for r in ingest.insert_missing(base, rows, ["k"]).collect()} == {"a", "b", "e"}
    cites = spark.createDataFrame([("c1", "N1"), ("c2", " n1 "), ("c2", " n1 "), ("c3", "n2"), ("c4", " "), ("c5", None)], "id string, legal_node_id string")
    assert [tuple(r) for r in ingest.shared_targets(cites).collect()] == [("n1", 2)]
    arts = spark.createDataFrame([("x", "d", 2), ("y", "d", 1), ("y", "d", 1), ("z", "e", 1)], "id string, k string, ord int")
    assert [tuple(r) for r in audit.repeats(arts, ["k"], ["ord", "id"]).collect()] == [("d", "x", "y")]
    dup = spark.createDataFrame([node("a", "v", None, "DOCUMENT", "doc"), node("b", "v", "a", "ARTICLE", "art-1"), node("c", "v", "a", "ARTICLE", "art-1")], NODE)
    assert [tuple(r) for r in audit.duplicate_keys(audit.nodes_once(dup, audit.PLACE), ["document_version_id", "source_locator"]).collect()] == [("v", "art-1", 2)]
    links = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")], "from_node string, to_node string, relation string")
    gone, kept = spark.createDataFrame([("b",), ("d",)], "id string"), spark.createDataFrame([("d",)], "id string")
    assert [tuple(r) for r in ingest.replace_relations(links, gone, kept).collect()] == [("c", "d", "r")]
    docs = spark.createDataFrame([("k1", " A1", "h"), ("k2", "a1", "g"), ("k3", None, "h"), ("k4", "none", None)], "id string, archive_id string, h string")
    kept = spark.createDataFrame([("a1", "old", D(2020, 1, 1)), ("a1", "h", D(2021, 1, 1))], "id string, sha256 string, fetched_at timestamp_ntz")
    assert {(r.id, r.archive_sha256, r.ok) for r in ingest.archived_bytes(docs, kept, "archive_id", "h").collect()} == {("k1", "h", True), ("k2", "h", False), ("k3", None, False), ("k4", None, False)}


def test_persist_is_all_or_nothing(spark, tmp_path):
    from lexcorpus.sources import corpus_store

    at = f"file://{tmp_path}/corpus"
    docs = spark.createDataFrame([("d", "t", T)], "id string, title string, updated_at timestamp_ntz")
    version = lambda i, n, a, b, status="PUBLISHED": (i, "d", n, a, b, "h", "p", status, "x", None)
    one = spark.createDataFrame([version("v1", 1, D(2020, 1, 1), D(2021, 1, 1))], VERSION)
    nodes = lambda v, n: spark.createDataFrame([node(f"r{v}", v, None, "DOCUMENT", "doc"), *(node(f"{v}a{i}", v, f"r{v}", "ARTICLE", f"art-{i}") for i in range(1, n + 1))], NODE)
    links = spark.createDataFrame([("v1a2", "v1a1", "refers"), ("x", "v1a1", "refers")], corpus_store.RELATIONS)
    corpus_store.persist(at, docs, one, nodes("v1", 2), links)
    for bad in (
        lambda: corpus_store.persist(at, docs, spark.createDataFrame([version("v2", 2, D(2020, 6, 1), None)], VERSION), nodes("v2", 1)),
        lambda: corpus_store.persist(at, docs, spark.createDataFrame([version("v2", 0, D(2022, 1, 1), None)], VERSION), nodes("v2", 1)),
        lambda: corpus_store.persist(at, docs, one, spark.createDataFrame([node("q", "v1", "gone", "ARTICLE", "art-1")], NODE)),
    ):
        with pytest.raises(ValueError):
            bad()
    assert snapshot.read_all(spark, at, corpus_store.TABLES)["nodes"].count() == 3
    corpus_store.persist(at, docs, spark.createDataFrame([version("v1", 1, D(2020, 1, 1), D(2021, 1, 1)), version("v2", 2, D(2022, 1, 1), None)], VERSION), nodes("v1", 1).unionByName(nodes("v2", 3)))
    now = snapshot.read_all(spark, at, corpus_store.TABLES)
    assert (now["nodes"].count(), now["versions"].count(), now["documents"].count()) == (6, 2, 1)
    assert [tuple(r) for r in now["relations"].collect()] == [("x", "v1a1", "refers")]  # the one with the replaced article is gone


def test_snapshot(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert snapshot.read(spark, at) is None
    snapshot.write(spark.range(3), at)
    snapshot.write(spark.range(5), at)
    assert snapshot.read(spark, at).count() == 5
    with pytest.raises(ValueError):
        snapshot.write(spark.range(9), at, checks=[lambda df: df.where("id = 8")])
    assert snapshot.read(spark, at).count() == 5


def test_buckets_rewrite_only_what_changes(spark, tmp_path):
    at, schema = f"file://{tmp_path}/b", "id int, v string, n int"
    put = lambda rows: snapshot.merge_buckets(spark.createDataFrame(rows, schema), at, "id", lambda base, new: ingest.upsert(base, new, "id", ["n"]), 8)
    assert snapshot.read_buckets(spark, at) is None and put([]) == []
    assert len(put([(i, "a", 1) for i in range(40)])) > 4
    first = {p.name for p in (tmp_path / "b").iterdir() if p.is_dir()}
    assert len(put([(3, "b", 2)])) == 1 and len(put([(3, "c", 3), (99, "z", 1)])) <= 2 and len(put([(3, "d", 4)])) == 1
    got = {r.id: r.v for r in snapshot.read_buckets(spark, at).collect()}
    assert len(got) == 41 and got[3] == "d" and got[4] == "a" and first <= {p.name for p in (tmp_path / "b").iterdir()}
    assert len([p for p in (tmp_path / "b").iterdir() if p.is_dir()]) <= 4  # states nobody names are gone


def test_archive_and_checkpoint(spark, tmp_path):
    import hashlib

    good = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "ar").mkdir()
    (tmp_path / "ar" / good).write_bytes(b"x")
    (tmp_path / "ar" / ("0" * 64)).write_bytes(b"y")
    assert sorted(r.intact for r in archive.archived(spark, str(tmp_path / "ar")).collect()) == [False, True]
    p = f"file://{tmp_path}/c/state.json"
    assert archive.read_checkpoint(spark, p) is None
    archive.write_checkpoint(spark, p, {"page": 2})
    archive.write_checkpoint(spark, p, {"page": 3})
    assert archive.read_checkpoint(spark, p)["page"] == 3 and archive.read_checkpoint(spark, p, version=2) is None
    (tmp_path / "c" / "state.json").write_text("{")
    (tmp_path / "c" / ".state.json.crc").unlink(missing_ok=True)
    assert archive.read_checkpoint(spark, p) is None
    archive.clear_checkpoint(spark, p)
    assert archive.read_checkpoint(spark, p) is None


def test_expected_locators(spark, corpus):
    expected = spark.createDataFrame([("7", "art-1"), ("7", "art-9"), ("99", "art-1")], "law_id string, locator string")
    assert {tuple(r) for r in audit.expected_locators(corpus.documents, corpus.versions, corpus.nodes, expected).collect()} == {("7", "art-1", "VALID"), ("7", "art-9", "UNRESOLVED"), ("99", "art-1", "UNRESOLVED")}
    several = corpus.nodes.unionByName(spark.createDataFrame([node("n9", "v2", "r2", "ARTICLE", "art-1")], NODE))
    assert audit.expected_locators(corpus.documents, corpus.versions, several, expected.limit(1)).first().status == "AMBIGUOUS"


def test_listing(spark):
    html = '<div class="shine-huuli-content"><a href="/mn/detail?lawId=8928">Act <b>A</b></a><i>№ 5</i><span>2006-07-06</span><span>2006-11-01</span><i class="fa fa-check"></i></div><div class="shine-huuli-content"><a href="/detail/15">B</a><a href="/x.PDF">file</a></div><a href="/law/26">c</a>'
    got = listing.cards(spark.createDataFrame([("p", html), ("q", None)], "page_id string, html string")).collect()
    assert [(r.law_id, r.title, r.document_number, r.issued_date, r.effective_date, r.status, r.pdf_available) for r in got] == [("8928", "Act", "№ 5", "2006-07-06", "2006-11-01", "ACTIVE", False), ("15", "B", None, None, None, "ARCHIVED", True)]
    assert [r.category_id for r in listing.categories(spark.createDataFrame([("p", html)], "page_id string, html string")).collect()] == ["26"]


def test_streams(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    rows = [(i, D(2024, 1, 1, i % 24), i % 3, ["error", "view", "purchase"][i % 2 + i // 20]) for i in range(40)]
    batch = spark.createDataFrame(rows, schema)
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pipelines.lifecycle_stream(stream(), "user_id", "event_type", "ts", "error").writeStream.format("memory").queryName("jobs").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    best = {}
    for r in spark.table("jobs").collect():
        if r.n_events >= best.get(r.job, (None, 0, 0))[2]:
            best[r.job] = (r.last_kind, r.retry_count, r.n_events)
    want = {str(r.user_id): (r.last_kind, r.retry_count, r.n_events) for r in ingest.lifecycle(batch, "user_id", "event_type", "ts", "error", "purchase").collect()}
    assert best == want
    pipelines.merge_into(stream(), f"file://{tmp_path}/merged", "event_id", ["ts"], str(tmp_path / "cp")).awaitTermination()
    merged = snapshot.read_buckets(spark, f"file://{tmp_path}/merged")
    assert merged.count() == 40 and merged.select("event_id").distinct().count() == 40


def test_discovery(spark):
    page = spark.createDataFrame([("p", 3, "https://a.example/mn/detail?lawId=3", "3", "t"), ("p", 1, "https://a.example/mn/detail?lawId=9", "9", "t"), ("q", 0, "https://a.example/mn/detail?lawId=3", "3", "t")], "page_id string, ordinal int, url string, law_id string, title string")
    ids = lambda **kw: [r.law_id for r in listing.discover(spark, "https://a.example", **kw).orderBy("ordinal").collect()]
    assert ids(url="https://a.example/detail/5", law_ids=["1"], listing=page) == ["5"] and ids(law_ids=["2", "1", "2"], listing=page) == ["2", "1"]
    assert ids(listing=page) == ["3", "9"] and ids(listing=page, limit=1) == ["3"] and ids() == []
    link = '<a class="act-name" href="https://a.example/detail/1">x</a>'
    pages = spark.createDataFrame([("c", 1, link), ("c", 2, '{"Html": "<a class=\\"act-name\\" href=\\"/detail/2\\">y</a>"}'), ("c", 3, "nothing"), ("c", 4, link), ("d", 1, None), ("e", 9, link)], "category string, page_no int, html string")
    assert sorted((r.category, r.page_no) for r in listing.until_empty(pages, 5).collect()) == [("c", 1), ("c", 2)]
    docs = spark.createDataFrame([('<a href="/f/A.PDF?v=1">p</a>',), ("<a onclick=\"downloadlaw('1', 77)\">d</a>",), ('<div class="x toolbar"><a href="/print">p</a></div>',), ("none",), (None,)], "h string")
    from pyspark.sql import functions as F

    assert [r.s for r in docs.select(listing.pdf_source(F.col("h")).alias("s")).collect()] == ["/f/A.PDF?v=1", "download:77", "/print", None, None]


def test_title_filter_and_staged_tables(spark, corpus):
    from lexcorpus import staging
    from lexcorpus.operators import retrieval as R

    hints = spark.createDataFrame([("ХӨДӨЛМӨР",), ("у",), ("ий",), ("zzz",), ("",), (None,)], "hint string")
    assert {tuple(r) for r in R.titled(hints, corpus.documents).collect()} == {("ХӨДӨЛМӨР", "d1"), ("у", "d1"), ("у", "d2"), ("ий", "d1")}
    kept = staging.Stage(spark, "t").write(spark.range(3), "x")
    place = kept.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
    assert kept.count() == 3 and os.path.exists(place)
    with staging.scope(spark):
        own = staging.Stage(spark, "t")
        gone = own.write(spark.range(3), "x").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(gone)
    assert not os.path.exists(gone) and os.path.exists(place)
    assert own.clear() == 1 and staging.clear(spark) >= 1 and not os.path.exists(place)
