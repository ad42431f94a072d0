from bidloom.functions import contacts, fuzzy, text
from bidloom.operators import evidence, matching, sections
from bidloom.plans import candidates, catalog, items, rollups  # noqa: F401
from bidloom.plans import evidence as evidence_queries
from pyspark.sql import functions as F


def test_switched_off_kinds_are_not_in_the_plan(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (None, 5)], "doc_a long, doc_b long")
    kinds = {"x": pairs.limit(1), "y": spark.createDataFrame([(3, 4)], "doc_a long, doc_b long")}
    got = {tuple(r) for r in evidence.flagged(pairs, kinds).collect()}
    assert got == {(1, 2, True, False, True), (3, 4, False, True, True), (None, 5, False, False, False)}
    assert evidence.flagged(pairs, kinds, ["y"]).columns == ["doc_a", "doc_b", "y", "has_evidence"]
    assert {r["has_evidence"] for r in evidence.flagged(pairs, kinds, []).collect()} == {False}


def test_mates_of_a_large_group_are_counted_and_the_first_are_shown(spark):
    rows = spark.createDataFrame([(i, "hot") for i in range(50)] + [(100, "own"), (101, None), (0, "hot")], "id long, v string")
    got = {r["id"]: r for r in evidence.mates(rows.distinct(), "id", ["v"], 5).collect()}
    assert got[0]["mates"] == [1, 2, 3, 4, 5] and got[40]["mates"] == [0, 1, 2, 3, 4] and got[0]["n_mates"] == 49
    assert got[100]["mates"] == [] and got[100]["n_mates"] == 0 and got[101]["mates"] == [] and got[101]["n_mates"] == 0


def test_one_failure_makes_a_request_an_error(spark):
    v = spark.createDataFrame([(1, 7, "SUCCESS", False), (2, 7, "FAILED", True), (3, 8, "FAILED", False), (4, None, "SUCCESS", None)], "id long, section long, status string, bad boolean")
    got = {r["id"]: (r["status"], r["stage"]) for r in evidence.or_error(v, ["section"], F.col("bad"), "download").collect()}
    assert got == {1: ("ERROR", "download"), 2: ("ERROR", "download"), 3: ("FAILED", None), 4: ("SUCCESS", None)}


def test_verdicts_keep_the_order_of_the_request(spark, data, monkeypatch):
    ids = [r[0] for r in spark.read.parquet(f"{data}/companies.parquet").select("company_record_id").distinct().orderBy(F.desc("company_record_id")).limit(3).collect()]
    for code in ("DOC_AUTHOR_SIMILAR", "SAME_bidderName_SIMILAR", "SAME_BID_CONTACT_SIMILAR"):
        got = items.analyze(spark, data, code, [ids[0], -5, ids[1], ids[0]]).collect()
        assert [r["company_record_id"] for r in got] == [ids[0], -5, ids[1]] and got[1]["status"] == "ERROR" and got[0]["status"] in ("SUCCESS", "FAILED")
    monkeypatch.setitem(catalog.QUERIES, "item_author", lambda s, d: 1 / 0)
    got = items.analyze(spark, data, "DOC_AUTHOR_SIMILAR", ids[:2]).collect()
    assert [r["status"] for r in got] == ["ERROR"] * 2 and "division" in got[0]["error"]


def test_names_of_contacts(spark):
    t = "联系人：王小明在现场，技术负责人 李四\n张三丰 项目经理 13812345678\n法定代表人：赵负责"
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    assert df.select(contacts.contact_names(F.col("t"))).first()[0] == ["王小明", "李四", "赵负", "张三丰"]
    assert contacts.merged_surnames(["张", "明远", "技术", "王", "1", "李"]) == ["张明远", "技术", "王", "1", "李"]
    got = contacts.potential_names("项目团队 张 明远 和 技术员 电话 13812345678。无关 李 四光", lambda s: s.split())
    assert got == ["张明远"] and contacts.potential_names(None) == []


def test_tokens_with_pairs_of_chinese_characters(spark):
    df = spark.createDataFrame([("招标文件 v2 A b 价",), (None,)], "t string")
    got = [r[0] for r in df.select(text.tokens(F.col("t"), True)).collect()]
    assert got == [["招标", "标文", "文件", "v2"], None]


def test_sentences_drop_short_ones_before_they_merge():
    a, b = "这是一个超过十五个字符的完整句子内容。", "第二个同样超过十五个字符的完整句子。"
    assert fuzzy.sentences(f"短句。{a}短。{b}") == [a + b]
    assert fuzzy.sentences("太短。也短。") == [] and len(fuzzy.sentences("字" * 1200)[0]) == 500
    assert [len(s) for s in fuzzy.sentences("字" * 1200)] == [500, 500, 400]


def test_lines_go_on_without_a_blank_unless_closed():
    assert fuzzy.repair_lines("the first line is broken\nin the middle") == "the first line is brokenin the middle"
    for closed in "》」』)\"]":
        assert fuzzy.repair_lines(f"the first line is closed{closed}\nin the middle") == f"the first line is closed{closed}\nin the middle"
    assert fuzzy.repair_lines("the first line is broken\n1. an item follows") == "the first line is broken\n1. an item follows"
    assert fuzzy.repair_lines("这一行没有结束，\n继续") == "这一行没有结束，继续" and fuzzy.repair_lines("a\r\n\n\n\n\n\nb") == "a\n\n\nb"


def test_ratio_over_a_bound_and_cover_of_common_parts():
    a, b = "the quick brown fox jumps over it", "the quick brown fox jumped over it"
    assert fuzzy.gated_ratio(a, b, 1, 1, 0.85) == fuzzy.gated_ratio(a, b, 1, 1) and fuzzy.gated_ratio("abc", "xyz", 1, 1, 0.85) == 0
    assert fuzzy.covered("a" * 100, "b" * 100, ["c" * 15]) and not fuzzy.covered("a" * 100, "b" * 100, ["c" * 14]) and fuzzy.covered("a", None, None)


def test_matches_take_the_ratio_then_the_cosine(spark):
    long = "word " * 30
    rows = [(1, 2, 1, 1, "same text that is long enough", "same text that is long enough", 1.0, 32, None), (1, 2, 2, 2, long, "other " * 30, 0.3, 8, 0.85), (1, 2, 3, 3, long, "other " * 30, 0.1, 8, 0.85), (1, 2, 4, 4, long, "other " * 30, 0.1, 8, 0.95), (1, 2, 5, 5, "short", "other", 0.3, 8, 0.85), (1, 2, 6, 6, long, "other " * 30, 0.3, 8, None)]
    df = spark.createDataFrame(rows, "doc_a long, doc_b long, para_a long, para_b long, text_a string, text_b string, jaccard double, slots int, cosine double")
    assert {(r["para_a"], r["method"]) for r in matching.routed(df).collect()} == {(1, "Exact-Jaccard"), (2, "SBERT"), (4, "SBERT")}
    assert {r["para_a"] for r in matching.routed(df, 2).collect()} == {1, 4}
    assert {r["para_a"] for r in matching.by_cosine(df).collect()} == {2, 4}


def test_contents_make_a_class_of_pages_surer(spark):
    pages = spark.createDataFrame([(1, 1, "目录\n技术方案 ........ 3\n商务标 ........ 9"), (1, 3, "技术方案"), (1, 9, "商务标"), (2, 1, "技术方案"), (3, 1, "质量保证 和 安全保证"), (4, 1, "nothing of note")], "doc_id long, page int, text string")
    docs = spark.createDataFrame([(1, 10), (2, 2), (3, None)], "doc_id long, page_count int")
    entries = sections.contents_entries(pages, docs)
    assert {(r["title"], r["printed"], r["label"]) for r in entries.collect()} == {("技术方案", 3, "technical"), ("商务标", 9, "commercial")}
    got = {(r["doc_id"], r["page"]): (r["label"], r["method"], r["confidence"]) for r in sections.page_classes(pages, docs).collect()}
    assert got[1, 9] == ("commercial", "toc_entries", 0.92) and got[2, 1] == ("technical", "body_anchors", 0.70) and got[3, 1] == ("technical", "keyword_density", 0.55) and got[4, 1] == ("unknown", "none", 0.0)


def test_new_queries_run_on_the_smallest_data(spark, data):
    for q in (evidence_queries.potential_names, rollups.load_errors, candidates.vector_filter):
        assert q(spark, data).count() >= 0
