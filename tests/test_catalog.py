import pytest

from bidloom.plans import catalog, items


@pytest.mark.parametrize("name", ["item_contact", "item_author", "page_sections", "risk_components", "doc_classes", "pair_text_score", "report_counters", "image_buckets", "quote_signature"])
def test_query_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_analyze_checks_its_arguments(spark, data):
    for bad in (("NO_SUCH_ITEM", None), ("DOC_AUTHOR_SIMILAR", []), ("TECH_BID_SIMILAR", [1])):
        with pytest.raises(ValueError):
            items.analyze(spark, data, *bad)
    got = items.analyze(spark, data, "DOC_AUTHOR_SIMILAR", [1, 2]).collect()
    assert {r["status"] for r in got} <= {"SUCCESS", "FAILED"}
