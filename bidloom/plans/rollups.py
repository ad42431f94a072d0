"""Rollups of documents and pages, page classes with confidence, pictures by page, and load errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import fixed, text
from bidloom.operators import images, sections, sketch
from bidloom.plans import catalog
from bidloom.plans.catalog import _LABELS, _P, _PAGES, _T, query
from bidloom.sources import store
from bidloom.sources.tables import table

_MONEY = r"list_filter(list_transform(list_zip(regexp_extract_all(text, '([\d,]+\.?\d*)\s*(万?)元', 1), regexp_extract_all(text, '([\d,]+\.?\d*)\s*(万?)元', 2)), lambda z : try_cast(replace(z[1], ',', '') AS DOUBLE) * CASE WHEN z[2] = '万' THEN 10000.0 ELSE 1.0 END), lambda v : v IS NOT NULL)"


@query(
    _P
    + f", pg AS (SELECT doc_id, count(*) AS paragraphs, count(DISTINCT page_num) AS chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS text_length FROM p GROUP BY doc_id), im AS (SELECT doc_id, count(DISTINCT image_hash) AS pictures FROM ocr_results GROUP BY doc_id),"
    f" am AS (SELECT doc_id, count(DISTINCT a) AS amounts, max(a) AS largest FROM (SELECT doc_id, unnest({_MONEY}) AS a FROM p WHERE text IS NOT NULL) GROUP BY doc_id)"
    " SELECT pg.*, coalesce(pictures, 0) AS pictures, coalesce(amounts, 0) AS amounts, largest FROM pg LEFT JOIN im USING (doc_id) LEFT JOIN am USING (doc_id)"
)
def doc_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What the parts of each document add up to: paragraphs, pages, characters, pictures and amounts of money."""
    p = catalog._once(spark, d)
    pages = p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.countDistinct("page_num").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("text_length"))
    pictures = table(spark, d, "ocr_results").groupBy("doc_id").agg(F.countDistinct("image_hash").alias("pictures"))
    amounts = p.filter("text is not null").select("doc_id", F.explode(text.money(F.col("text"))).alias("a")).groupBy("doc_id").agg(F.countDistinct("a").alias("amounts"), F.max("a").alias("largest"))
    rows = pages.join(pictures, "doc_id", "left").join(amounts, "doc_id", "left")
    return rows.select("doc_id", "paragraphs", "chunks", "text_length", F.coalesce("pictures", F.lit(0)).alias("pictures"), F.coalesce("amounts", F.lit(0)).alias("amounts"), "largest")


@query(
    _T
    + ", f AS (SELECT doc_id, page_num, token, count(*) AS tf FROM (SELECT t.*, p.page_num FROM t JOIN p USING (para_id, doc_id)) WHERE page_num IS NOT NULL GROUP BY doc_id, page_num, token), b AS (SELECT doc_id, page_num, part, bit, sum(CASE WHEN (('0x' || substr(md5(token), 17 + 8 * part, 8))::BIGINT >> bit) & 1 = 1 THEN tf ELSE -tf END) AS s FROM f, range(2) x(part), range(32) y(bit) GROUP BY ALL),"
    " h AS (SELECT doc_id, page_num, CAST(sum(CASE WHEN part = 0 AND s > 0 THEN 1::BIGINT << bit ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN part = 1 AND s > 0 THEN 1::BIGINT << bit ELSE 0 END) AS BIGINT) AS low FROM b GROUP BY doc_id, page_num)"
    " SELECT doc_id, bit_and(high) AS high, bit_and(low) AS low, count(*) AS pages FROM h WHERE high <> 0 OR low <> 0 GROUP BY doc_id"
)
def simhash_and(spark: SparkSession, d: str) -> DataFrame:
    """Each document's bits that the hashes of all its pages have; pages without a hash don't count."""
    tokens = catalog._once(spark, d).filter("page_num is not null").select("doc_id", "page_num", F.explode("tokens").alias("t")).select(F.struct("doc_id", "page_num").alias("page"), F.lower("t").alias("token")).filter(F.length("token") > 1)
    hashes = sketch.simhash(tokens.groupBy("page", "token").agg(F.count("*").alias("tf")), "page").filter("high <> 0 or low <> 0")
    return hashes.groupBy(F.col("page.doc_id").alias("doc_id")).agg(F.bit_and("high").alias("high"), F.bit_and("low").alias("low"), F.count("*").alias("pages"))


@query(
    "WITH q AS (SELECT o_custkey, round(o_totalprice, 2) AS v FROM orders), g AS (SELECT o_custkey, lpad(CAST(CAST(floor(round((v - floor(v)) * 100, 4)) AS INTEGER) AS VARCHAR), 2, '0') AS tail FROM q), h AS (SELECT o_custkey, tail, count(*) AS n FROM g GROUP BY o_custkey, tail)"
    " SELECT o_custkey, list(tail || ':' || n ORDER BY tail) AS tails, CAST(coalesce(max(CASE WHEN tail = '00' THEN n END), 0) AS BIGINT) AS whole FROM h GROUP BY o_custkey"
)
def tail_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each pair of cents ends a customer's amounts, as a map by cents; at most a hundred entries a customer."""
    v = F.col("v")
    tails = table(spark, d, "orders").select("o_custkey", F.round("o_totalprice", 2).alias("v")).select("o_custkey", F.lpad(F.floor(F.round((v - F.floor(v)) * 100, 4)).cast("int").cast("string"), 2, "0").alias("tail"))
    counted = tails.groupBy("o_custkey", "tail").agg(F.count("*").alias("n"))
    maps = counted.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("tail", "n"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat_ws(":", k, F.element_at("m", k).cast("string")))
    return maps.select("o_custkey", entries.alias("tails"), F.coalesce(F.try_element_at("m", F.lit("00")), F.lit(0)).cast("long").alias("whole"))


@query("SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 2")
def quantity_price_correlation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count("*").alias("n")).filter("n > 2")


@query("SELECT doc_id, nullif(author, '') AS author, page_count FROM documents")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Metadata written as JSON and read again."""
    rows = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.when(F.col("author") != "", F.col("author")).alias("author"), "page_count")).alias("j"))
    return rows.select("doc_id", F.from_json("j", "author string, page_count int").alias("x")).select("doc_id", "x.author", "x.page_count")


@query(
    "WITH f AS (SELECT DISTINCT source, doc_id, md5(coalesce(filename, '') || '|' || coalesce(CAST(page_count AS VARCHAR), '') || '|' || coalesce(strftime(extracted_at, '%Y-%m-%d %H:%M:%S'), '')) AS h FROM documents)"
    " SELECT source, count(*) AS files, md5(CAST(count(*) AS VARCHAR) || '|' || CAST(CAST(sum(('0x' || left(h, 8))::BIGINT) AS BIGINT) AS VARCHAR)) AS input_hash FROM f GROUP BY source"
)
def input_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each source's list of files (name, size, time), from sums, so that no list is gathered; it changes when a file does."""
    part = lambda c: F.coalesce(c, F.lit(""))
    h = F.md5(F.concat_ws("|", part(F.col("filename")), part(F.col("page_count").cast("string")), part(F.date_format("extracted_at", "yyyy-MM-dd HH:mm:ss"))))
    rows = table(spark, d, "documents").select("source", "doc_id", h.alias("h")).distinct()
    total = F.sum(F.conv(F.left("h", F.lit(8)), 16, 10).cast("long"))
    return rows.groupBy("source").agg(F.count("*").alias("files"), F.md5(F.concat_ws("|", F.count("*").cast("string"), total.cast("string"))).alias("input_hash"))


# pages


_TOC = (
    _PAGES
    + r", dp AS (SELECT doc_id, any_value(page_count) AS pages FROM documents GROUP BY doc_id), fp AS (SELECT g.doc_id, g.page, g.text FROM g JOIN dp USING (doc_id) WHERE page <= greatest(8, CAST(floor(pages * 0.12) AS INTEGER))), ln AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS raw FROM fp), lt AS (SELECT * FROM (SELECT doc_id, page, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM ln) WHERE line <> ''),"
    rf" tm AS (SELECT *, regexp_matches(line, '{fixed.TOC_ENTRY}') AS entry, regexp_matches(line, '{fixed.TOC_FILL}') OR regexp_matches(line, '{fixed.TOC_ENTRY}') AS like_toc FROM lt),"
    " tp AS (SELECT doc_id, page FROM (SELECT doc_id, page, count(*) AS n, count(*) FILTER (WHERE like_toc) AS k FROM tm GROUP BY doc_id, page) JOIN fp USING (doc_id, page) WHERE k >= greatest(2, n // 4) OR contains(left(fp.text, 200), '目录')),"
    rf" te AS (SELECT doc_id, page, trim(regexp_extract(line, '{fixed.TOC_ENTRY}', 1)) AS title, CAST(regexp_extract(line, '{fixed.TOC_ENTRY}', 2) AS INTEGER) AS printed FROM tm JOIN tp USING (doc_id, page) WHERE entry),"
    " tq AS (SELECT *, CASE WHEN regexp_matches(title, '" + "|".join(fixed.COMMERCIAL_TERMS) + "') THEN 'commercial' WHEN regexp_matches(title, '" + "|".join(fixed.TECHNICAL_TERMS) + "') THEN 'technical' END AS label FROM te)"
)


@query(_TOC + " SELECT DISTINCT tq.doc_id, tq.page, title, printed, label FROM tq JOIN dp USING (doc_id) WHERE printed BETWEEN 1 AND pages + 50")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    """Lines of tables of contents on front pages: title, printed page and, where a term says it, the part."""
    pages = sections.page_texts(table(spark, d, "paragraphs"))
    return sections.contents_entries(pages, table(spark, d, "documents"))


_CLASSES = (
    _LABELS.replace(_PAGES, _TOC, 1).replace("CASE WHEN short AND", "CASE WHEN EXISTS (SELECT 1 FROM tp WHERE tp.doc_id = mk.doc_id AND tp.page = mk.page) THEN NULL WHEN short AND", 1)
    + ", en AS (SELECT doc_id, count(*) FILTER (WHERE label = 'technical') AS nt, count(*) FILTER (WHERE label = 'commercial') AS nc FROM tq JOIN dp USING (doc_id) WHERE printed BETWEEN 1 AND pages + 50 AND label IS NOT NULL GROUP BY doc_id)"
    " SELECT lb.doc_id, lb.page, lb.label, CASE WHEN lb.method = 'title' AND en.doc_id IS NOT NULL THEN 'toc_entries' WHEN lb.method = 'title' THEN 'body_anchors' WHEN lb.method = 'density' THEN 'keyword_density' ELSE 'none' END AS method,"
    " CAST(CASE WHEN lb.method = 'title' AND en.doc_id IS NOT NULL THEN CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN 0.92 ELSE 0.72 END WHEN lb.method = 'title' THEN CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN 0.84 ELSE 0.70 END WHEN lb.method = 'density' THEN CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN 0.58 ELSE 0.55 END ELSE 0.0 END AS DOUBLE) AS confidence"
    " FROM lb JOIN ch USING (doc_id) LEFT JOIN en USING (doc_id)"
)


@query(_CLASSES)
def page_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each page's part with the strategy that told it (contents with titles, titles, density of terms) and its confidence."""
    pages = sections.page_texts(table(spark, d, "paragraphs"))
    return sections.page_classes(pages, table(spark, d, "documents"))


@query(_LABELS + ", oc AS (SELECT DISTINCT ocr_id, doc_id, page_num, image_hash FROM ocr_results) SELECT oc.ocr_id, oc.doc_id, oc.page_num FROM oc LEFT JOIN lb ON lb.doc_id = oc.doc_id AND lb.page = oc.page_num WHERE lb.label = 'technical' OR oc.page_num IS NULL")
def image_dimension_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pictures on technical pages; those of no known page pass."""
    pictures = table(spark, d, "ocr_results").select("ocr_id", "doc_id", "page_num", "image_hash").distinct()
    return images.in_dimension(pictures, catalog.page_sections(spark, d), "technical").select("ocr_id", "doc_id", "page_num")


@query(
    _LABELS
    + ", fo AS (SELECT doc_id, min(page_num) AS page FROM ocr_results GROUP BY doc_id), im AS (SELECT DISTINCT doc_a, doc_b FROM image_matches), tg AS (SELECT im.doc_a, im.doc_b, coalesce(la.label, 'unknown') AS a, coalesce(lb2.label, 'unknown') AS b FROM im LEFT JOIN fo fa ON fa.doc_id = doc_a LEFT JOIN fo fb ON fb.doc_id = doc_b LEFT JOIN lb la ON la.doc_id = doc_a AND la.page = fa.page LEFT JOIN lb lb2 ON lb2.doc_id = doc_b AND lb2.page = fb.page)"
    " SELECT doc_a, doc_b, CASE WHEN a = 'technical' AND b = 'technical' THEN 'tech_image' WHEN a = 'commercial' AND b = 'commercial' THEN 'com_image' WHEN a <> b AND 'technical' IN (a, b) AND 'commercial' IN (a, b) THEN 'tech_image+com_image' ELSE 'unknown' END AS tag FROM tg"
)
def image_tags(spark: SparkSession, d: str) -> DataFrame:
    """The part that the first pictures of two matching documents belong to."""
    first = table(spark, d, "ocr_results").groupBy("doc_id").agg(F.min("page_num").alias("page"))
    return images.dimension_tags(table(spark, d, "image_matches").select("doc_a", "doc_b").distinct(), first, catalog.page_sections(spark, d))


@query("WITH b AS (SELECT DISTINCT image_hash FROM ocr_results WHERE w < 200 OR h < 200) SELECT DISTINCT ocr_id, image_hash FROM ocr_results o WHERE image_hash <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.image_hash = o.image_hash)")
def image_blacklist(spark: SparkSession, d: str) -> DataFrame:
    """Pictures whose hash isn't among those of marks and icons, which small pictures give."""
    ocr = table(spark, d, "ocr_results")
    return images.allowed(ocr, ocr.filter("w < 200 or h < 200").select("image_hash").distinct()).select("ocr_id", "image_hash").distinct()


@query("SELECT image_hash, arg_min(left(text, 200), ocr_id) AS text FROM ocr_results WHERE image_hash <> '' AND text IS NOT NULL GROUP BY image_hash")
def ocr_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """The text of the first picture of each hash, 200 characters."""
    return images.text_of_hash(table(spark, d, "ocr_results"))


@query(
    "WITH di AS (SELECT w FROM (SELECT DISTINCT lower(w) AS w, doc_id FROM (SELECT doc_id, unnest(tokens) AS w FROM paragraphs)) WHERE length(w) >= 2 AND regexp_matches(w, '[^\\x00-\\x7F]') GROUP BY w HAVING count(*) BETWEEN 2 AND 50), pw AS (SELECT DISTINCT doc_id, lower(x) AS w FROM (SELECT doc_id, unnest(tokens) AS x FROM paragraphs)), im AS (SELECT DISTINCT doc_a, doc_b FROM image_matches)"
    " SELECT doc_a, doc_b, list(a.w ORDER BY a.w)[1:10] AS words, count(*) AS n FROM im JOIN pw a ON a.doc_id = doc_a JOIN pw b ON b.doc_id = doc_b AND a.w = b.w JOIN di ON di.w = a.w GROUP BY doc_a, doc_b HAVING count(*) >= 2"
)
def shared_rare_words(spark: SparkSession, d: str) -> DataFrame:
    """Rare words of the dictionary, not all ASCII, that both documents of a pair have, if there are two or more; the first ten."""
    words = table(spark, d, "paragraphs").select("doc_id", F.explode("tokens").alias("w")).select("doc_id", F.lower("w").alias("w")).distinct()
    dictionary = words.filter(F.length("w") >= 2).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n").between(2, 50)).select("w")
    return images.rare_words(table(spark, d, "image_matches"), words, dictionary, 2)


@query(
    "SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS key, 'load' AS stage, 'text is missing' AS message FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT DISTINCT 'paragraphs', CAST(para_id AS VARCHAR), 'load', 'page is unknown' FROM paragraphs WHERE page_num IS NULL OR page_num < 1"
    " UNION ALL SELECT DISTINCT 'text_embedding_cache', CAST(vec_id AS VARCHAR), 'vectors', 'vector is unusable' FROM text_embedding_cache WHERE embedding IS NULL OR len(embedding) <> 384 OR list_contains(list_transform(embedding, lambda x : isnan(x)), true)"
)
def load_errors(spark: SparkSession, d: str) -> DataFrame:
    """What of the inputs can't be used, as a table of errors with stage and cause; the rest goes on."""
    from bidloom.operators import vectors

    docs, paragraphs, cache = (table(spark, d, n) for n in ("documents", "paragraphs", "text_embedding_cache"))
    bad = store.errors(docs, "documents", "doc_id", "load", {"text is missing": F.trim(F.coalesce("text", F.lit(""))) == ""})
    bad = bad.union(store.errors(paragraphs.dropDuplicates(["para_id"]), "paragraphs", "para_id", "load", {"page is unknown": F.col("page_num").isNull() | (F.col("page_num") < 1)}))
    return bad.union(store.errors(cache.dropDuplicates(["vec_id"]), "text_embedding_cache", "vec_id", "vectors", {"vector is unusable": ~F.coalesce(vectors.usable(F.col("embedding"), 384), F.lit(False))}))
