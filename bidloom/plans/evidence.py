"""Evidence of pairs, and the check items' verdicts with what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators import evidence
from bidloom.plans import catalog, items
from bidloom.plans.catalog import _C, _P, query
from bidloom.sources.tables import table

_LAST = "r0 AS (SELECT company_record_id, section_id, doc_id, bidder_name, bid_file_url FROM companies QUALIFY row_number() OVER (PARTITION BY company_record_id ORDER BY submitted_at DESC NULLS LAST, bid_file_url NULLS LAST, bidder_name NULLS LAST) = 1)"


def _file_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.trim("text") != "").select("doc_id", F.md5("text").alias("file_id")).dropDuplicates(["doc_id"])


@query("WITH h AS (SELECT doc_id, any_value(CASE WHEN trim(text) <> '' THEN md5(text) END) AS file_id FROM documents GROUP BY doc_id) SELECT file_id, list(doc_id ORDER BY doc_id)[1:20] AS docs, count(*) AS n FROM h WHERE file_id IS NOT NULL GROUP BY file_id HAVING count(*) > 1")
def file_id_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one file id (that of their text, where no file is at hand): their number and the first 20."""
    rows = evidence.mates(_file_ids(spark, d), "doc_id", ["file_id"], 19).filter("n_mates > 0")
    return rows.groupBy("file_id").agg(F.sort_array(F.array_union(F.min_by("mates", "doc_id"), F.array(F.min("doc_id")))).alias("docs"), F.count("*").alias("n"))


_HAS = (
    _C
    + r""", pr AS (SELECT DISTINCT doc_a, doc_b FROM image_matches),
dm AS (SELECT doc_id, lower(trim(any_value(author))) AS author, any_value(CASE WHEN trim(text) <> '' THEN md5(text) END) AS file_id FROM documents GROUP BY doc_id),
pp AS (SELECT DISTINCT doc_id, md5(text) AS h FROM paragraphs WHERE length(text) >= 15), ih AS (SELECT DISTINCT doc_id, image_hash FROM ocr_results WHERE image_hash <> ''),
z AS (SELECT doc_a, doc_b,
 EXISTS (SELECT 1 FROM pp a JOIN pp b ON a.h = b.h WHERE a.doc_id = pr.doc_a AND b.doc_id = pr.doc_b) AS paragraphs,
 EXISTS (SELECT 1 FROM dm a JOIN dm b ON a.author = b.author WHERE a.doc_id = pr.doc_a AND b.doc_id = pr.doc_b AND a.author <> '') AS author,
 EXISTS (SELECT 1 FROM dm a JOIN dm b ON a.file_id = b.file_id WHERE a.doc_id = pr.doc_a AND b.doc_id = pr.doc_b) AS file_id,
 EXISTS (SELECT 1 FROM ih a JOIN ih b ON a.image_hash = b.image_hash WHERE a.doc_id = pr.doc_a AND b.doc_id = pr.doc_b) AS image,
 EXISTS (SELECT 1 FROM e a JOIN e b ON a.kind = b.kind AND a.value = b.value WHERE a.kind = 'company' AND a.doc_id = pr.doc_a AND b.doc_id = pr.doc_b) AS company,
 EXISTS (SELECT 1 FROM e a JOIN e b ON a.kind = b.kind AND a.value = b.value WHERE a.kind = 'mobile' AND a.doc_id = pr.doc_a AND b.doc_id = pr.doc_b) AS mobile FROM pr)
SELECT *, paragraphs OR author OR file_id OR image OR company OR mobile AS has_evidence FROM z"""
)


def evidence_kinds(spark: SparkSession, d: str, pairs: DataFrame) -> dict[str, DataFrame]:
    """The pairs of each kind of evidence that counts; shared e-mails, names, landlines and codes don't."""
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"])
    e = catalog.contact_entities(spark, d)
    of = lambda k: evidence.sharing(pairs, e.filter(F.col("kind") == k).select("doc_id", "value"))
    return {
        "paragraphs": evidence.sharing(pairs, table(spark, d, "paragraphs").filter(F.length("text") >= 15).select("doc_id", F.md5("text").alias("h")).distinct()),
        "author": evidence.sharing(pairs, docs.select("doc_id", F.lower(F.trim("author")).alias("author")).filter("author <> ''")),
        "file_id": evidence.sharing(pairs, _file_ids(spark, d)),
        "image": evidence.sharing(pairs, table(spark, d, "ocr_results").filter("image_hash <> ''").select("doc_id", "image_hash").distinct()),
        "company": of("company"),
        "mobile": of("mobile"),
    }


@query(_HAS)
def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of evidence each candidate pair has, and whether it has any."""
    pairs = table(spark, d, "image_matches").select("doc_a", "doc_b").distinct()
    return evidence.flagged(pairs, evidence_kinds(spark, d, pairs))


@query(_HAS.rsplit("SELECT *, paragraphs", 1)[0] + "SELECT doc_a, doc_b, company, mobile, company OR mobile AS has_evidence FROM z")
def pair_evidence_contacts(spark: SparkSession, d: str) -> DataFrame:
    """``pair_evidence`` with only the contact kinds switched on; the others aren't computed."""
    pairs = table(spark, d, "image_matches").select("doc_a", "doc_b").distinct()
    return evidence.flagged(pairs, evidence_kinds(spark, d, pairs), ["company", "mobile"])


@query(
    _HAS.rsplit("SELECT *, paragraphs", 1)[0].replace("WITH r AS", "WITH RECURSIVE r AS", 1)
    + ", eg AS (SELECT doc_a AS a, doc_b AS b FROM z WHERE paragraphs OR author OR file_id OR image OR company OR mobile), u AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg), w(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.node) SELECT node, min(root) AS component FROM w GROUP BY node"
)
def evidence_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the documents over pairs with any evidence."""
    from bidloom.operators import graph

    return graph.components(pair_evidence(spark, d).filter("has_evidence").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))


_KEYS = (
    f"WITH {_LAST}, k AS (SELECT doc_id, any_value(trim(author)) AS author, any_value(CASE WHEN trim(coalesce(creator, '')) <> '' OR trim(coalesce(producer, '')) <> '' THEN coalesce(creator, '') || '|' || coalesce(producer, '') END) AS editor, any_value(CASE WHEN trim(text) <> '' THEN md5(text) END) AS file_code FROM documents GROUP BY doc_id),"
    " x AS (SELECT company_record_id, 'author' AS item, nullif(author, '') AS key FROM r0 LEFT JOIN k USING (doc_id) UNION ALL SELECT company_record_id, 'editor', editor FROM r0 LEFT JOIN k USING (doc_id) UNION ALL SELECT company_record_id, 'file_code', file_code FROM r0 LEFT JOIN k USING (doc_id)),"
    " g AS (SELECT item, key, list(company_record_id ORDER BY company_record_id)[1:21] AS ids, count(*) AS n FROM x WHERE key IS NOT NULL GROUP BY item, key)"
    " SELECT company_record_id, item, key, CASE WHEN n > 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status, coalesce(list_filter(ids, lambda i : i <> company_record_id)[1:20], CAST([] AS BIGINT[])) AS mates, coalesce(n - 1, 0) AS n_mates FROM x LEFT JOIN g USING (item, key)"
)


@query(_KEYS)
def company_mates(spark: SparkSession, d: str) -> DataFrame:
    """For the items author, editor and file code: each company's value, and the first 20 other companies with the same."""
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"])
    author = F.trim("author")
    keys = docs.select("doc_id", F.when(author != "", author).alias("author"), items.editor_key().alias("editor"), F.when(F.trim("text") != "", F.md5("text")).alias("file_code"))
    rows = items.requests(table(spark, d, "companies")).join(keys, "doc_id", "left")
    rows = rows.select("company_record_id", F.inline(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("key")) for k in ("author", "editor", "file_code")])))
    found = evidence.mates(rows, "company_record_id", ["item", "key"])
    return found.select("company_record_id", "item", "key", F.when(F.col("n_mates") > 0, "FAILED").otherwise("SUCCESS").alias("status"), "mates", "n_mates")


@query(
    _C.replace("WITH r AS", f"WITH {_LAST}, r AS")
    + """, s AS (SELECT doc_id, kind, list(value ORDER BY value)[1:20] AS shared, count(*) AS n FROM e JOIN g USING (kind, value) WHERE g.docs > 1 AND kind IN ('mobile', 'landline', 'email', 'contact') GROUP BY doc_id, kind)
SELECT company_record_id, kind, shared, n FROM r0 JOIN s USING (doc_id)"""
)
def company_contacts(spark: SparkSession, d: str) -> DataFrame:
    """For each company and kind of contact: the values that another document has too (the first 20), and how many."""
    shared = catalog.contact_entities(spark, d).join(catalog.contact_groups(spark, d).select("kind", "value"), ["kind", "value"]).filter(F.col("kind").isin("mobile", "landline", "email", "contact"))
    # a document's values are few, a value's documents may be many: only the first are gathered
    each = shared.groupBy("doc_id", "kind").agg(F.slice(F.sort_array(F.collect_list("value")), 1, evidence.SHOWN).alias("shared"), F.count("*").alias("n"))
    return items.requests(table(spark, d, "companies")).join(each, "doc_id").select("company_record_id", "kind", "shared", "n")


@query(
    _C.replace("WITH r AS", f"WITH {_LAST}, r AS")
    + """, b AS (SELECT DISTINCT trim(bidder_name) AS name, company_record_id, doc_id FROM r0 WHERE trim(bidder_name) <> ''),
n AS (SELECT name, count(*) AS bids FROM b GROUP BY name), o AS (SELECT name, doc_id, count(*) AS own FROM b GROUP BY name, doc_id),
f AS (SELECT e.doc_id, list(e.value ORDER BY e.value)[1:20] AS names, CAST(sum(n.bids - coalesce(o.own, 0)) AS BIGINT) AS others FROM e JOIN n ON e.value = n.name LEFT JOIN o ON o.name = e.value AND o.doc_id = e.doc_id WHERE e.kind = 'company' AND n.bids - coalesce(o.own, 0) > 0 GROUP BY e.doc_id)
SELECT company_record_id, section_id, CASE WHEN f.doc_id IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status, coalesce(names, CAST([] AS VARCHAR[])) AS names, coalesce(others, 0) AS others FROM r0 LEFT JOIN f USING (doc_id)"""
)
def item_bidder_name(spark: SparkSession, d: str) -> DataFrame:
    """Each company's verdict: FAILED if its document names another company's exact bidder name; the names found (the first 20), and how many companies bid under them."""
    last = items.requests(table(spark, d, "companies"), "bidder_name")
    bids = last.select(F.trim("bidder_name").alias("value"), "company_record_id", "doc_id").filter("value <> ''").distinct()
    total, own = bids.groupBy("value").agg(F.count("*").alias("bids")), bids.groupBy("value", "doc_id").agg(F.count("*").alias("own"))
    rows = catalog.contact_entities(spark, d).filter("kind = 'company'").join(total, "value").join(own, ["value", "doc_id"], "left").withColumn("n", F.col("bids") - F.coalesce("own", F.lit(0)))
    found = rows.filter("n > 0").groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("value")), 1, evidence.SHOWN).alias("names"), F.sum("n").alias("others"))
    rows = last.join(found, "doc_id", "left")
    return rows.select("company_record_id", "section_id", F.when(F.col("others") > 0, "FAILED").otherwise("SUCCESS").alias("status"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("others", F.lit(0)).alias("others"))


@query(
    f"WITH {_LAST}, k AS (SELECT doc_id, any_value(trim(author)) AS key FROM documents GROUP BY doc_id), x AS (SELECT r0.*, k.key, k.doc_id AS found FROM r0 LEFT JOIN k USING (doc_id)), g AS (SELECT key, count(*) AS n FROM x WHERE key <> '' GROUP BY key), q AS (SELECT section_id, bool_or(trim(coalesce(bid_file_url, '')) = '' OR found IS NULL) AS bad FROM x GROUP BY section_id)"
    " SELECT company_record_id, section_id, CASE WHEN (SELECT bad FROM q WHERE q.section_id IS NOT DISTINCT FROM x.section_id) THEN 'ERROR' WHEN g.n > 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN (SELECT bad FROM q WHERE q.section_id IS NOT DISTINCT FROM x.section_id) THEN 'download' END AS stage FROM x LEFT JOIN g USING (key)"
)
def section_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The author item with each section as one request: one company without a file makes the verdicts of all its companies ERROR."""
    last = items.requests(table(spark, d, "companies"), "bid_file_url")
    verdicts = catalog.item_author(spark, d).select("company_record_id", "section_id", "status").join(last.select("company_record_id", "bid_file_url", "doc_id"), "company_record_id")
    rows = verdicts.join(table(spark, d, "documents").select("doc_id", F.lit(True).alias("there")).distinct(), "doc_id", "left")
    return evidence.or_error(rows, ["section_id"], (F.trim(F.coalesce("bid_file_url", F.lit(""))) == "") | F.col("there").isNull(), "download").select("company_record_id", "section_id", "status", "stage")


@query(_P + ", c AS (SELECT doc_id, page_num, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_num NULLS LAST, para_index, para_id) - 1 AS i, para_id FROM p) SELECT para_id, doc_id, CAST(i AS INTEGER) AS global_index FROM c")
def global_index(spark: SparkSession, d: str) -> DataFrame:
    """The number of each paragraph in its document, over all pages, from 0."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("page_num"), "para_index", "para_id")
    return catalog._once(spark, d).select("para_id", "doc_id", (F.row_number().over(order) - 1).alias("global_index"))


@query(
    r"WITH x AS (SELECT doc_id, regexp_extract_all(text, '" + catalog.fixed.CONTACT_NAME + "', 1) AS a, regexp_extract_all(text, '" + catalog.fixed.CONTACT_TABLE + "', 1) AS b FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest(list_concat(a, b)) AS n FROM x) SELECT DISTINCT doc_id, regexp_replace(n, '^(.{2,}?)[" + catalog.fixed.NAME_TAIL + r"]+$', '\1') AS name FROM y"
)
def contact_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of persons that texts give with a role."""
    from bidloom.functions import contacts

    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(contacts.contact_names(F.col("text"))).alias("name")).distinct()


@query()
def potential_names(spark: SparkSession, d: str) -> DataFrame:
    """Words near contact data that could be names of persons; the tokenizer decides, so SQL can't."""
    from bidloom.functions import contacts

    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(contacts.potential_names_in("text")).alias("name"))


@query(
    r"WITH x AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[一-龥]{2,}')) AS w FROM x), b AS (SELECT doc_id, substr(w, i, 2) AS w FROM (SELECT doc_id, w, unnest(range(1, length(w))) AS i FROM r)), o AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '[一-龥]', ' ', 'g'), '[\p{L}\p{N}]+')) AS w FROM x)"
    " SELECT doc_id, count(DISTINCT w) AS words FROM (SELECT * FROM b UNION ALL SELECT * FROM o WHERE length(w) > 1) GROUP BY doc_id"
)
def token_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """How many different words each text has, with Chinese runs as pairs of characters."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(text.tokens(F.col("text"), True)).cast("long").alias("words"))
    return rows.filter("words > 0")
