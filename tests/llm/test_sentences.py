import pytest

from lexcorpus.llm.sentences import sentences


def units(spark, text):
    df = spark.createDataFrame([(1, text, "x", 9)], "doc_id bigint, text string, u string, start_pos int")
    rows = sorted((r.start_pos, r.end_pos, r.sentence) for r in sentences(df, with_text=True).collect())
    for a, b, s in rows:
        assert text[a:b] == s == s.strip()
    return [s for _, _, s in rows]


CASES = [
    ("Нэг өгүүлбэр болно. Хоёр дахь нь 91.7 хувь.", ["Нэг өгүүлбэр болно.", "Хоёр дахь нь 91.7 хувь."]),
    ("Д. Бомборжав, Ж.Хордолмаа нар проф. Тэлгүүдэй ирэв. Дараа нь төг. авав г.м. Энэ.", ["Д. Бомборжав, Ж.Хордолмаа нар проф. Тэлгүүдэй ирэв.", "Дараа нь төг. авав г.м.", "Энэ."]),
    ("Хууль болно.Талжу мөрдөнө", ["Хууль болно.", "Талжу мөрдөнө"]),
    ("12.6. Эрх зүй болно.\n\nХоёр. Гарчиг\n \nIV. Бас нэг\nмөр болно.", ["12.6. Эрх зүй болно.", "Хоёр. Гарчиг", "IV. Бас нэг\nмөр болно."]),
    ("Тухай:\n1) нэг зүйл;\n2) хоёр зүйл.\n\nДараа.", ["Тухай:\n1) нэг зүйл;\n2) хоёр зүйл.", "Дараа."]),
    ("Тэр «Энэ юу вэ? Мэдэхгүй.» гэв. «Бүтэн өгүүлбэр!» Дараа нь (тийм үү?) ирэв.", ["Тэр «Энэ юу вэ? Мэдэхгүй.» гэв.", "«Бүтэн өгүүлбэр!»", "Дараа нь (тийм үү?) ирэв."]),
    ("3.1. \"Тайлан гаргана?\" Энэ бол (Бүгд мөрдөнө.) гэсэн.", ["3.1. \"Тайлан гаргана?\"", "Энэ бол (Бүгд мөрдөнө.) гэсэн."]),
    ("See Art. 5 of Brindle Ltd. v. Tarn Inc. today at 5 p.m. Next comes J. Ostrander etc. 2011 was good... or not?! Yes", ["See Art. 5 of Brindle Ltd. v. Tarn Inc. today at 5 p.m.", "Next comes J. Ostrander etc.", "2011 was good... or not?!", "Yes"]),
    ("В 2002 г. Суд решил по ст. 17 и т. п. Далее им. Кустовейко и т.д. Всё.", ["В 2002 г.", "Суд решил по ст. 17 и т. п.", "Далее им. Кустовейко и т.д.", "Всё."]),
    ("Go to https://a.example/d/1.Html?x=Y or mail info@a.example.Test now. Done 2021.01.07 ok.", ["Go to https://a.example/d/1.Html?x=Y or mail info@a.example.Test now.", "Done 2021.01.07 ok."]),
    ("本法“谁管？”的规定。第1.7条！是吗？好……完", ["本法“谁管？”的规定。", "第1.7条！", "是吗？", "好……", "完"]),
    ("本法を「定める。」と報告する。終わり。", ["本法を「定める。」と報告する。", "終わり。"]),
    ("वह सं. 18 है। डॉ. पीप आया! रु. 855… और", ["वह सं. 18 है।", "डॉ. पीप आया!", "रु. 855… और"]),
    ("ᠲᠠᠰᠢᠳᠣ ᠮᠢᠮᠢ᠃ ᠯᠥᠷᠦ᠂ ᠴᠢᠯᠢ᠉ ᠵᠦᠲᠢ? ᠮᠤ", ["ᠲᠠᠰᠢᠳᠣ ᠮᠢᠮᠢ᠃", "ᠯᠥᠷᠦ᠂ ᠴᠢᠯᠢ᠉", "ᠵᠦᠲᠢ?", "ᠮᠤ"]),
    ("คุณ น้ำ มติ 41 ตาม", ["คุณ", "น้ำ", "มติ 41 ตาม"]),
    ("a\r\nb\r\n\r\n c  ", ["a\r\nb", "c"]),
    ("\n\n  ", []),
    ("", []),
    (" a. B", [" a.", "B"]),
    ("((( unclosed « ab. B", ["((( unclosed « ab.", "B"]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(spark, text, want):
    assert units(spark, text) == want


def test_nulls_long_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    assert sentences(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert sentences(spark.createDataFrame([], schema)).count() == 0
    assert sentences(spark.createDataFrame([(1, "Ab cd. " * 20_000), (2, "a. b " * 30_000)], schema)).groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 20_000), (2, 1)]


def test_units_cover_everything_but_blanks(spark):
    text = "".join(t + "\n\n" for t, _ in CASES[:17])
    rows = sorted((r.start_pos, r.end_pos) for r in sentences(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect())
    at = 0
    for a, b in rows:
        assert not text[at:a].strip() and a < b
        at = b
    assert not text[at:].strip()
