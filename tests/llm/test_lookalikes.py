from lexcorpus.llm.lookalikes import consistent, disguised, letters


def forms(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, batch string")
    return [r.t for r in consistent(df, ["t"], ["id"]).orderBy("id").collect()]


def same(spark, a, b):
    x, y = forms(spark, a, b)
    return x == y


def test_what_looks_the_same(spark):
    for a, b in [("ＡＢ１，", "AB1,"), ("Ёё", "Ёё"), ("ё", "ë"), ("й", "й"), ("a​b­", "ab"), ("и‍̆", "й"), ("a b", "a b"), ("a　b", "a\tb"), ("Рок", "Pок"), ("ΧΡο", "XPo"), ("Дɵм", "Дөм"), ("Ɵ", "Ө")]:
        assert same(spark, a, b), (a, b)


def test_what_looks_different(spark):
    for a, b in [("е", "ё"), ("и", "й"), ("A", "a"), ("м²", "м2"), ("№", "No"), ("у", "ү"), ("о", "ө"), ("э", "е"), ("a  b", "a b"), ("Ү", "У")]:
        assert not same(spark, a, b), (a, b)


def test_nulls_and_quotes(spark):
    assert forms(spark, None, "", "​", "it's") == [None, "", "", "it's"] and len(forms(spark, "ж" * 100_000)[0]) == 100_000
    a, b = letters()
    assert len(a) == len(b.replace("''", "'"))


def test_pairs(spark):
    node = "id string, document_version_id string, source_locator string, title string, text string, updated_at int, form string, raw string"
    rows = [("n1", "v1", "art-1", "Хууль", "Текст", 1), ("n2", "v2", "art-1", "Xууль", "Текст", 1), ("n2", "v2", "art-1", "Xууль", "Текст", 1), ("n3", "v3", "art-1", "Хууль", "Тексt", 1), ("n4", "v1", "art-1", "Xуyль", "Текст", 1), ("m", "w", "art-1", "Xууль", "", 1), ("n5", "v2", "art-2", None, None, 1), ("n6", "v2", None, "Хууль", "", 1)]
    nodes = spark.createDataFrame([(*r, "f", "r") for r in rows], node)
    versions = spark.createDataFrame([("v1", "d"), ("v2", "d"), ("v3", "d"), ("v3", "d"), ("w", "e")], "id string, document_id string")
    got = sorted(tuple(r) for r in disguised(nodes, versions, ["title", "text"]).collect())
    assert got == [("n1", "n2", "title"), ("n2", "n3", "title"), ("n2", "n4", "title"), ("n3", "n4", "title")]
    assert disguised(nodes.limit(0), versions, ["title", "text"]).count() == 0
