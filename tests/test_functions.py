import pytest
from pyspark.sql import functions as F

from lexcorpus.functions import citations as C
from lexcorpus.functions import html as H
from lexcorpus.functions import payload as P
from lexcorpus.functions import urls as U
from lexcorpus.operators import search as S

CATALOGUE = C.Catalogue()


@pytest.mark.parametrize(
    "text, want",
    [
        ("17", ("17", None, None, None)), ("17.1", ("17", "1", None, None)), ("17.1 дүгээр зүйл", ("17", "1", None, None)), ("Article 17.1", ("17", "1", None, None)), ("Art. 17(1)", ("17", "1", None, None)),
        ("17.1.2", ("17", "1", "2", None)), ("17.1.2.3", ("17", "1", "2", "3")), ("17 дугаар зүйлийн 1 дэх хэсгийн 2 дахь заалт", ("17", "1", "2", None)), ("17 дугаар зүйлийн 1 дэх хэсгийн 2 дахь заалтын 3 дахь цэг", ("17", "1", "2", "3")), ("дүгээр зүйл", (None,) * 4), ("1.2.3.4.5", ("1", "2", "3", "4.5")),
    ],
)
def test_locators(text, want):
    assert tuple(C.locate(C.tokens(text)).values()) == want


@pytest.mark.parametrize(
    "text, code, article",
    [("ЭХ 17.1", "CRIMINAL_CODE", "17"), ("ИХ 15.2", "CIVIL_CODE", "15"), ("Үндсэн хуулийн 16 дугаар зүйл", "CONSTITUTION", "16"), ("Эрүүгийн хэрэг хянан шийдвэрлэх тухай хууль 10.1", "CRIMINAL_PROCEDURE", "10"), ("Administrative Procedure Code 4.2", "ADMINISTRATIVE_PROCEDURE", "4"), ("Government Resolution 12.1", "GOVERNMENT_RESOLUTION", "12"), ("Сайдын тушаал 8", "MINISTERIAL_ORDER", "8"), ("International Treaty 3.1", "INTERNATIONAL_TREATY", "3"), ("17.1", None, "17"), ("according to 17.1 the court held", None, "17"), ("not a citation", None, None), ("  ", None, None)],
)
def test_instruments(text, code, article):
    got = C.normalize(text, CATALOGUE)
    assert (got["code"], got["article"], got["original_text"]) == (code, article, text)


def test_catalogue():
    assert CATALOGUE.find(C.tokens("Criminal Code Article 17.1"))[2] == ["article", "17.1"]
    with pytest.raises(ValueError):
        C.Catalogue([("A", "LAW", ["a"]), ("A", "LAW", ["b"])])


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([("Эрүүгийн хуулийн 17.1 дүгээр зүйл",), (None,), ("",), ("x 5.6 y",)], "t string")
    got = [tuple(r.p) for r in df.select(C.parse_phrase(F.col("t")).alias("p")).collect()]
    assert got == [("17", "1", "art-17/p-1", "Эрүүгийн"), (None,) * 4, (None,) * 4, ("5", "6", "art-5/p-6", None)]
    assert [r.n.code for r in df.select(C.normalizer()("t").alias("n")).collect()] == ["CRIMINAL_CODE", None, None, None]
    assert [r.f for r in df.select(C.folder()("t").alias("f")).collect()][1] is None
    assert spark.range(1).select(C.citation_key(F.lit("1622"), F.lit("article-17")).alias("k"), C.citation_key(F.lit(""), F.lit("x")).alias("e")).first() == ("1622:article-17", "x")


def test_addresses(spark):
    rows = [("https://a.example/mn/detail?lawId=29#x",), ("HTTP://A.EXAMPLE/detail/77?p=1",), ("https://u:p@a.example/",), ("old.example/detail?x=1&lawId=5",), (None,), ("nonsense",)]
    df = spark.createDataFrame(rows, "u string").select("u", U.law_id(F.col("u")).alias("law"), U.canonical(F.col("u"), "https://c.example").alias("c"), U.allowed(F.col("u"), ["a.example"]).alias("ok"), U.host(F.col("u")).alias("h"))
    got = [(r.law, r.c, r.ok, r.h) for r in df.collect()]
    assert got[0] == ("29", "https://c.example/mn/detail?lawId=29", True, "a.example") and got[1][0] == "77" and got[1][2] is False
    assert got[2][2] is False and got[3][0] == "5" and got[4] == (None, None, False, None) and got[5][:2] == (None, "nonsense")
    ips = spark.createDataFrame([(x,) for x in ("10.0.0.1", "172.20.1.1", "172.40.1.1", "::1", "fd00::1", "::ffff:127.0.0.1", "8.8.8.8", "2001:db8::1")], "ip string")
    assert [r.p for r in ips.select(U.private_ip(F.col("ip")).alias("p")).collect()] == [True, True, False, True, True, True, False, False]
    waits = spark.createDataFrame([(1,), (2,), (6,), (60,)], "a int").select(U.backoff_ms(F.col("a")).alias("w"))
    assert [r.w for r in waits.collect()] == [500, 1000, 16000, 16000]
    hop = spark.createDataFrame([(301, "https://a.example/", "https://b.a.example/", 1), (301, "https://a.example/", "https://evil.example/", 1), (200, "https://a.example/", "https://a.example/", 1), (302, "https://a.example/", "https://a.example/", 6)], "s int, a string, b string, n int")
    assert [r.r for r in hop.select(U.redirect_allowed(*map(F.col, "sabn")).alias("r")).collect()] == [True, False, False, False]


def test_payloads(spark):
    rows = [("application/pdf", "x"), ("text/html", "%PDF-1"), ("application/msword", "x"), (None, " <!DOCTYPE HTML>"), ("text/plain", "x"), ("text/html", "")]
    df = spark.createDataFrame(rows, "m string, b string").withColumn("k", P.sniff(F.col("m"), F.col("b")))
    assert [(r.k, r.a) for r in df.select("k", P.accepted(F.col("k"), F.col("m"), F.col("b")).alias("a")).collect()] == [("pdf", "ok"), ("pdf", "ok"), ("word", "ok"), ("html", "ok"), ("unknown", "unexpected_type:text/plain"), ("html", "empty_body")]
    j = spark.createDataFrame([('{"a":1}',), ("[1]",), ("3",), ("{",), (None,)], "j string")
    assert [r.o for r in j.select(P.json_object(F.col("j")).alias("o")).collect()] == ['{"a":1}', None, None, None, None]
    d = spark.createDataFrame([("2020-02-30",), ("2020-02-03T00:00:00Z",), ("2020/02/03",), (None,)], "d string")
    assert [str(r.x) for r in d.select(P.strict_date(F.col("d")).alias("x")).collect()] == ["None", "2020-02-03", "None", "None"]


PAGE = """<html><head><title>Туршилтын хууль</title></head><body><nav>цэс</nav><div id="bordered-tab1"><div class="law_content"><p>НЭГДҮГЭЭР БҮЛЭГ Нийтлэг</p>
<p>1 дүгээр зүйл. Зорилт</p><p>1. Эхний хэсэг</p><p>1.1. нэг дэх заалт</p><p>1.2. хоёр дахь</p><p>Хэвлэх</p><p>үргэлжлэл</p><p>29<sup>1</sup> дүгээр зүйл. Нэмэлт</p><p>29^1.2. хэсэг</p><p>6 дугаар зүйл. A</p><p>6.1.1. дэд</p><p>6.6. зургаа</p><p>6.7. долоо</p><p>11 .1. буцах</p></div></div></body></html>"""


def parse(spark, html):
    df = spark.createDataFrame([("d", html)], "doc_id string, html string").select("doc_id", H.title(F.col("html")).alias("title"), H.lines(F.lit(H.isolate(html) if html else None).cast("string")).alias("lines"))
    return {r.locator: r for r in H.provisions(df).collect()}


def test_page_to_provisions(spark):
    got = parse(spark, PAGE)
    assert list(got)[0] == "doc" and got["doc"].title == "Туршилтын хууль"
    assert {"ch-1", "art-1", "art-1/p-1", "art-1/p-1/c-1", "art-1/p-1/c-2", "art-29^1", "art-29^1/p-2", "art-6", "art-6/p-1/c-1", "art-6/p-6", "art-6/p-7"} <= set(got)
    assert "art-6/p-6/c-7" not in got and got["art-1/p-1/c-2"].text == "хоёр дахь үргэлжлэл" and got["art-1"].title == "Зорилт"
    assert list(parse(spark, "")) == ["doc"] and list(parse(spark, None)) == ["doc"]


def test_headings_in_words():
    o = H.Outline("t")
    for line in ("АРВАН ХОЁРДУГААР БҮЛЭГ", "ГУРАВДУГААР ЗҮЙЛ", "ДОЛООДУГААР БҮЛЭГ^1", "1.10 дугаар зүйл. B", "1.10.1.1. x"):
        o.feed(line)
    assert [r["locator"] for r in o.rows][1:5] == ["ch-12", "art-3", "ch-7^1", "art-1.10"]


def test_annex_signature_and_the_whole_way_from_a_page(spark):
    o = H.Outline("t")
    for line in ("1 дүгээр зүйл. A", "1.1. нэг", "МОНГОЛ УЛСЫН ИХ ХУРЛЫН ДАРГА Ж. Нэр", "үргэлжлэл", "Хавсралт 1", "хүснэгт", "2 дугаар зүйл. B", "Хавсралтын тухай"):
        o.feed(line)
    got = {r["locator"]: r for r in o.rows}
    assert got["art-1/p-1"]["text"] == "нэг үргэлжлэл" and got["annex-2"]["text"] == "Хавсралт 1" and got["annex-2"]["parent"] == 0 and got["art-2"]["text"].endswith("Хавсралтын тухай")
    page = '<title>x</title><div>Хэвлэх</div><div id="bordered-tab1"><p>БАТЛАГДСАН: 2006-07-06</p><div class="a law_content"><p>НЭР ХУУЛЬ</p><div><p>1 дүгээр зүйл. A</p></div><p>1.1. нэг</p></div>after</div><p>хүчин төгөлдөр болсон 2006-13-01</p>'
    acts, rows = H.parsed(spark.createDataFrame([("a", page), ("b", None), ("c", "plain")], "doc_id string, html string"))
    a = {r.doc_id: r for r in acts.collect()}
    assert (a["a"].title, str(a["a"].adopted_at), a["a"].effective_from) == ("НЭР ХУУЛЬ", "2006-07-06", None) and a["b"].title == "Untitled" and a["c"].title == "plain"
    assert [(r.locator, r.text) for r in rows.where("doc_id = 'a'").orderBy("ordinal").collect()] == [("doc", "НЭР ХУУЛЬ"), ("art-1", "1 дүгээр зүйл. A"), ("art-1/p-1", "нэг")]


def test_search_pieces(spark):
    df = spark.createDataFrame([("two words",), ("",), (None,)], "t string")
    assert [round(r.s, 4) for r in df.select(S.similarity(F.col("t"), "word").alias("s")).collect()] == [0.3636, 0.0, 0.0]
    t = spark.createDataFrame([("Ажлаас үндэслэлгүй халах",), ("Гэрлэлт цуцлах журам",)], "t string")
    assert [round(r.s, 3) for r in t.select(S.similarity(F.col("t"), "Намайг ажлаас үндэслэлгүй халсан").alias("s")).collect()][0] == 0.611
    hit = lambda q: [r.h for r in spark.createDataFrame([("big red dog",), ("red cat",)], "t string").select(S.websearch(S.lexemes(F.col("t")), q).alias("h")).collect()]
    assert hit("red") == [True, True] and hit('"red dog"') == [True, False] and hit("dog or cat") == [True, True] and hit("red -cat") == [True, False] and hit("  ") == [False, False]
    at = lambda words, q: [r.d for r in spark.createDataFrame([(words,)], "w array<string>").select(S.cover_density(F.col("w"), q).alias("d")).collect()][0]
    assert at(["a", "b"], "a b") == pytest.approx(0.1) and at(["a", "x", "b"], "b a") == pytest.approx(0.05) and at(["a", "b", "a"], "a b") == pytest.approx(0.2)
    assert at(["a", "x"], "a b") == 0 and at(None, "a") == 0 and at([], "a") == 0 and at(["a"], " ") == 0 and at(["b", "a", "a", "x", "b"], "a b") == pytest.approx(0.1 + 0.05)


def test_index_gives_what_the_scan_gives(spark):
    from lexcorpus.staging import Stage

    rows = [("n1", "v1", "l1", "Ажлаас халах эрх", "Ажлаас үндэслэлгүй халах эрх"), ("n2", "v1", "l2", None, "халах ажлаас эрх халах"), ("n3", "v2", "l1", "Ажлаас халах эрх", None), ("n4", "v1", "l3", "Бусад", "эрх"), ("n5", "v1", "l1", "ажлаас халах эрхийн", "x"), ("n6", None, None, None, None)]
    nodes = spark.createDataFrame([(*r, 1, "b") for r in rows], "id string, document_version_id string, source_locator string, title string, text string, bucket int, term string")
    versions = spark.createDataFrame([("v1", "d1", "PUBLISHED", None, None), ("v2", "d2", "DRAFT", None, None)], "id string, document_id string, status string, effective_from timestamp_ntz, effective_to timestamp_ntz")
    index = S.build_index(nodes, Stage(spark, "t").write)
    for q in ("ажлаас халах эрх", "эрх", "zzz", " ", "халах ажлаас ажлаас"):
        want = sorted(map(tuple, S.open_question(nodes, versions, q).collect()), key=repr)
        assert sorted(map(tuple, S.open_question_indexed(index, versions, q).collect()), key=repr) == want
    plan = S.indexed_candidates(index, "эрх")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
