from datetime import date, timedelta

from lexcorpus.llm.matching import latin, matches
from pyspark.sql import functions as F

SCHEMA = "id string, title string, number string, day string, address string, jurisdiction string, kind string, rule string, d_id string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


NAMES = [f"{a} {b} {c} тухай хууль" for a, b, c in zip("Гарталт Чагдаглт Зохусцёг Мөммэлын Шошас Нэрвэм Дүси Сабонтай Харрам Рамдоын Цонжёйлах Сажамийн".split(), "түмбэрд чёйтай дөдүл лүйнэмд сёцаслах жумтулшотай чэлэйн төгтүлтай гэйжөс цойжёр цэбэр мэлбүд".split(), "сүнзий дэлцэц бөнцэ насбуын гэгэрлах бүжөр цорбавар зэтүл добуй цөшэ нүгү нэнзэл".split())]


def test_cascade(spark):
    acts = [(f"a{i}", t, f"А/{100 + i}", f"2010-0{i % 9 + 1}-1{i % 9}", f"https://k.example/mn/detail?lawId={7000 + i}", "MN", "LAW") for i, t in enumerate(NAMES)]
    acts += [("twin1", "Ихэр тухай хууль", "1", "2001-01-01", None, "MN", "LAW"), ("twin2", "Ихэр тухай хууль", "2", "2002-01-01", None, "MN", "LAW"), ("blank", None, None, None, None, None, None)]
    seen = [(f"s{i}", t.upper(), str(100 + i), f"2010-0{i % 9 + 1}-2{i % 9}", f"http://o.example/law/details/{7000 + i}", "mn", "act") for i, t in enumerate(NAMES)]
    free = [
        ("f0", "  " + NAMES[0] + " .", "2010/100", None, None, "MN", "act"), ("f1", spark.range(1).select(latin(F.lit(NAMES[1]))).first()[0], None, "2010.02.11", None, "MN", "Хууль"), ("f2", "ЭХ: " + NAMES[2] + " /2010 он/", "№ 102", "n/a", None, "Mongol", None),
        ("wrong-number", NAMES[3], "999", None, None, "MN", "act"), ("wrong-date", NAMES[4], "0", "1999-01-01", None, "MN", "act"), ("amending", "Шошас сёцаслах насбуын тухай хуульд өөрчлөлт оруулах тухай", None, None, None, "MN", "act"), ("twin", "Ихэр тухай хууль", None, None, None, "MN", "act"),
        ("twin-n", "Ихэр тухай хууль", "2", None, None, "MN", "act"), ("none", None, None, None, None, None, None), ("other-act", NAMES[5], None, None, "http://o.example/law/details/99999", "MN", "act"),
    ]
    got = {r.knowledge_id: r.document_id for r in matches(make(spark, acts), make(spark, seen + free + free[:2])).collect()}
    assert {k: got[k] for k in got if k.startswith("s")} == {f"s{i}": f"a{i}" for i in range(len(NAMES))}
    assert {k: v for k, v in got.items() if k[0] != "s"} == {"f0": "a0", "f1": "a1", "f2": "a2", "twin-n": "twin2"}


def test_confidence_and_empty(spark):
    acts = [(f"a{i}", t, None, None, f"https://k.example/mn/detail?lawId={7000 + i}", "MN", "LAW") for i, t in enumerate(NAMES)]
    seen = [(f"s{i}", t, None, None, f"http://o.example/law/details/{7000 + i if i % 2 else 1}", "MN", "act") for i, t in enumerate(NAMES)] + [("f", NAMES[0], None, None, None, "MN", "act")]
    # half of the labelled matches of the rule are wrong: it isn't trusted
    assert "f" not in {r.knowledge_id for r in matches(make(spark, acts), make(spark, seen)).collect()}
    found = {r.knowledge_id: r.document_id for r in matches(make(spark, acts), make(spark, seen)).collect()}
    assert found == {f"s{i}": f"a{i}" for i in range(1, len(NAMES), 2)}  # addresses alone are enough
    r = {r.knowledge_id: r.confidence for r in matches(make(spark, acts), make(spark, seen), least=0.0).collect()}
    assert r["f"] == 0.5
    assert matches(make(spark, []), make(spark, seen)).count() == 0 and matches(make(spark, acts), make(spark, [])).count() == 0


def test_acts_that_differ_behind_the_slug(spark):
    base, amending = "Гарталт түмбэрд сүнзий Чагдаглт чёйтай дэлцэц тухай хууль", "Гарталт түмбэрд сүнзий Чагдаглт чёйтай дэлцэц тухай хуульд өөрчлөлт оруулах тухай"
    slug = "http://www.o.example/" + spark.range(1).select(F.substring(F.replace(latin(F.lit(base)), F.lit(" "), F.lit("-")), 1, 40)).first()[0] + ".html"
    acts = [(f"a{i}", t, str(100 + i), f"2010-0{i % 9 + 1}-1{i % 9}", f"https://k.example/mn/detail?lawId={7000 + i}", "MN", "LAW") for i, t in enumerate(NAMES)]
    acts += [("base", base, None, None, None, "MN", "LAW"), ("only-amending", NAMES[0] + "д өөрчлөлт оруулах тухай", None, None, None, "MN", "LAW")]
    seen = [(f"s{i}", t, None, None, f"http://o.example/law/details/{7000 + i}", "MN", "act") for i, t in enumerate(NAMES)]
    free = [
        ("amending", amending, None, None, None, "MN", "act"), ("amending-slug", amending, "7", "2011-01-01", slug, "MN", "act"), ("base", base, None, None, None, "MN", "act"), ("base-slug", base.replace("чёйтай", "чётйай"), "7", None, slug, "MN", "act"),
        ("cut-slug", base[:30] + "…", None, None, slug, "MN", "act"), ("no-title-slug", None, None, None, slug, "MN", "act"),
    ]
    got = {r.knowledge_id: r.document_id for r in matches(make(spark, acts), make(spark, seen + free), least=0.0).collect()}
    assert {k: v for k, v in got.items() if k[0] != "s"} == {k: "base" for k in ("base", "base-slug", "cut-slug", "no-title-slug")}


def test_key_of_very_many_acts(spark):
    title, days = "Хэтэрхий олон тухай хууль", [date(2001, 1, 1) + timedelta(45 * i) for i in range(60)]
    acts = [(f"m{i}", title, str(200 + i), str(x), None, "MN", "LAW") for i, x in enumerate(days)] + [("undated", title, "900", None, None, "MN", "LAW")]
    acts += [(f"a{i}", t, None, None, f"https://k.example/mn/detail?lawId={7000 + i}", "MN", "LAW") for i, t in enumerate(NAMES)]
    seen = [(f"s{i}", t, None, None, f"http://o.example/law/details/{7000 + i}", "MN", "act") for i, t in enumerate(NAMES)]
    free = [(f"later{i}", title, "999", str(x + timedelta(i % 32)), None, "MN", "act") for i, x in enumerate(days)]  # no act has the number
    free += [(f"unnumbered{i}", title, None, str(x + timedelta(31)), None, "MN", "act") for i, x in enumerate(days)]  # the undated act is possible as well
    free += [("undated", title, None, None, None, "MN", "act"), ("after", title, "900", str(days[5] + timedelta(40)), None, "MN", "act"), ("number", title, "217", None, None, "MN", "act")]
    acts += [("free", title, None, "1990-01-01", None, "MN", "LAW")]
    free += [("free", title, "998", "1990-02-01", None, "MN", "act")]
    got = {r.knowledge_id: r.document_id for r in matches(make(spark, acts), make(spark, seen + free), least=0.0).collect()}
    assert {k: v for k, v in got.items() if k[0] != "s"} == {"after": "undated", "number": "m17", "free": "free"}
    some = [(a, t, None, *x) for a, t, _, *x in acts if a != "undated"]
    got = {r.knowledge_id: r.document_id for r in matches(make(spark, some), make(spark, seen + [f for f in free if f[0].startswith("unnumbered")]), least=0.0).collect()}
    assert {k: v for k, v in got.items() if k[0] != "s"} == {f"unnumbered{i}": f"m{i}" for i in range(len(days))}
