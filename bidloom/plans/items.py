"""Check items: one verdict for each company of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.sources import store

#: Item codes and what they check.
ITEMS = {
    "FILE_CODE_SIMILAR": "item_file_code",
    "EDITOR_SIGNER_SIMILAR": "item_editor",
    "DOC_AUTHOR_SIMILAR": "item_author",
    "SAME_BID_CONTACT_SIMILAR": "item_contact",
    "SAME_bidderName_SIMILAR": "item_bidder_name",
    "TECH_BID_SIMILAR": "item_text_technical",
    "Business_BID_SIMILAR": "item_text_commercial",
}


def requests(companies: DataFrame, *more: str) -> DataFrame:
    """The last submission of each request row, with further columns of it."""
    rows = store.upserted(companies, ["company_record_id"], [F.desc_nulls_last("submitted_at"), F.asc_nulls_last("bid_file_url"), F.asc_nulls_last("bidder_name")])
    return rows.select("company_record_id", "section_id", "doc_id", *more)


def editor_key() -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~(blank("creator") & blank("producer")), F.concat(F.coalesce("creator", F.lit("")), F.lit("|"), F.coalesce("producer", F.lit(""))))


def same_value(companies: DataFrame, documents: DataFrame, key: Column) -> DataFrame:
    """FAILED for companies whose document shares the key with another company's; null and empty keys match nothing."""
    keys = documents.select("doc_id", key.alias("key")).dropDuplicates(["doc_id"])
    rows = requests(companies).join(keys, "doc_id", "left")
    groups = rows.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(1))
    return rows.join(groups, "key", "left").select("company_record_id", "section_id", F.when(n > 1, "FAILED").otherwise("SUCCESS").alias("status"), (n - 1).alias("similar_companies"))


def contact(companies: DataFrame, entities: DataFrame, groups: DataFrame) -> DataFrame:
    shared = entities.join(groups.select("kind", "value"), ["kind", "value"])
    n = lambda k: F.count_if(F.col("kind") == k)
    counts = shared.groupBy("doc_id").agg(n("mobile").alias("mobiles"), n("landline").alias("phones"), n("email").alias("emails"), n("contact").alias("persons"))
    names = ["mobiles", "phones", "emails", "persons"]
    rows = requests(companies).join(counts, "doc_id", "left").na.fill(0, names)
    return rows.select("company_record_id", "section_id", F.when(sum((F.col(x) for x in names[1:]), F.col(names[0])) > 0, "FAILED").otherwise("SUCCESS").alias("status"), *names)


def text_verdicts(companies: DataFrame, scores: DataFrame, matches: DataFrame) -> DataFrame:
    """(company_record_id, section_id, status, best, similar, paragraphs)."""
    both = lambda df, *rest: df.select(F.col("doc_a").alias("doc_id"), *rest).union(df.select(F.col("doc_b").alias("doc_id"), *rest))
    best = both(scores, F.col("score")).groupBy("doc_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= 0.3).alias("similar"))
    found = both(matches, F.lit(1).alias("one")).groupBy("doc_id").agg(F.count("*").alias("paragraphs"))
    rows = requests(companies).join(best, "doc_id", "left").join(found, "doc_id", "left").na.fill(0, ["best", "similar", "paragraphs"])
    return rows.select("company_record_id", "section_id", F.when((F.col("best") >= 0.3) | (F.col("paragraphs") > 0), "FAILED").otherwise("SUCCESS").alias("status"), "best", "similar", "paragraphs")


def analyze(spark, directory: str, item_code: str, company_record_ids: list[int] | None = None) -> DataFrame:
    """The verdicts of one check item, for some companies in the order of the request (column ``place``), or for all.

    Every company asked for has a row: one that isn't in the table is an ERROR.
    Unknown items and empty requests are errors of the call; what fails while the
    plan is made gives an ERROR for every company, with the stage and the cause.
    """
    from bidloom.plans import catalog, evidence  # noqa: F401

    if item_code not in ITEMS:
        raise ValueError(f"unknown item: {item_code}")
    if company_record_ids is not None and not company_record_ids:
        raise ValueError("no companies given")
    if company_record_ids is not None and len(company_record_ids) < 2 and item_code in ("TECH_BID_SIMILAR", "Business_BID_SIMILAR"):
        raise ValueError("two companies or more are needed")
    if company_record_ids is None:
        return catalog.QUERIES[ITEMS[item_code]](spark, directory)
    asked = spark.createDataFrame([(i, int(c)) for i, c in enumerate(dict.fromkeys(company_record_ids))], "place int, company_record_id long")
    try:
        rows = catalog.QUERIES[ITEMS[item_code]](spark, directory)
    except Exception as e:  # noqa: BLE001 - a request always gets its verdicts
        return asked.select("place", "company_record_id", F.lit("ERROR").alias("status"), F.lit("plan").alias("stage"), F.lit(str(e)[:500]).alias("error")).orderBy("place")
    found = F.broadcast(asked).join(rows, "company_record_id", "left").withColumn("status", F.coalesce("status", F.lit("ERROR")))
    return found.select("place", *rows.columns).orderBy("place")
