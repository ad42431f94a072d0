from datetime import datetime

from bidloom.functions import fixed
from bidloom.plans import catalog, items


def candidates(spark, signatures):
    """Pairs of documents; each document has one paragraph of the same number, with the given signature."""
    sketches = spark.createDataFrame(list(signatures.items()), "para_id long, sig array<long>")
    words = [f"w{i}" for i in range(12)]
    paragraphs = spark.createDataFrame([(k, k, words) for k in signatures], "para_id long, doc_id long, tokens array<string>")
    return {tuple(r) for r in catalog._lsh(sketches, paragraphs).collect()}


def test_half_of_the_slots_makes_a_candidate(spark):
    base = list(range(32))
    agree = lambda n, other: base[:n] + [other + i for i in range(32 - n)]
    got = candidates(spark, {1: base, 2: agree(16, 1000), 3: agree(20, 2000), 4: agree(25, 3000), 5: agree(15, 4000)})
    assert {p for p in got if 1 in p} == {(1, 2), (1, 3), (1, 4)}


def test_every_document_of_a_class_reaches_the_stage(spark, tmp_path):
    passage, near = [f"w{i}" for i in range(20)], [f"w{i}" for i in range(19)] + ["other"]
    rows = [(10 * k, k, 0, 1, " ".join(w), w, "text") for k, w in ((1, passage), (2, passage), (3, passage), (4, near))]
    spark.createDataFrame(rows, "para_id long, doc_id long, para_index int, page_num int, text string, tokens array<string>, source string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    spark.createDataFrame([], "doc_a long, doc_b long, similarity double").write.parquet(f"{tmp_path}/image_matches.parquet")
    got = {(r["doc_a"], r["doc_b"]) for r in catalog.paragraph_stage1(spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert {tuple(r) for r in catalog.lsh_classes(spark, str(tmp_path)).collect()} == {(10, 1, 10), (20, 2, 10), (30, 3, 10), (40, 4, 40)}
    assert {tuple(r) for r in catalog.lsh_links(spark, str(tmp_path)).collect()} == {(10, 40)}


def test_text_items_differ_by_dimension(spark, tmp_path):
    shared = [f"passage{i}" for i in range(20)]
    rows = []
    for doc in (1, 2):
        pages = {1: [fixed.TECHNICAL_TITLES[0]], 2: shared, 3: [fixed.COMMERCIAL_TITLES[0]], 4: [f"own{doc}x{i}" for i in range(20)]}
        rows += [(10 * doc + page, doc, page, page, " ".join(w), w, "text") for page, w in pages.items()]
    spark.createDataFrame(rows, "para_id long, doc_id long, para_index int, page_num int, text string, tokens array<string>, source string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    spark.createDataFrame([], "doc_a long, doc_b long, similarity double").write.parquet(f"{tmp_path}/image_matches.parquet")
    companies = [(doc, 1, doc, f"firm {doc}", "u", datetime(2026, 1, 1)) for doc in (1, 2)]
    spark.createDataFrame(companies, "company_record_id long, section_id long, doc_id long, bidder_name string, bid_file_url string, submitted_at timestamp").write.parquet(f"{tmp_path}/companies.parquet")
    status = lambda item: {r["status"] for r in items.analyze(spark, str(tmp_path), item).collect()}
    assert status("TECH_BID_SIMILAR") == {"FAILED"}
    assert status("Business_BID_SIMILAR") == {"SUCCESS"}
