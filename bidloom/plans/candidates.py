"""Candidate pairs: the generators, their union and the filter by document vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators import setjoin, sketch
from bidloom.operators import vectors as vector_ops
from bidloom.plans import catalog
from bidloom.plans.catalog import _META, _SH, _SIM, _V, query
from bidloom.sources.tables import table

#: Documents of a section up to which all pairs are candidates.
SMALL_SECTION = 5


@query(
    "WITH d AS (SELECT DISTINCT doc_id, section_id FROM documents WHERE section_id IS NOT NULL), s AS (SELECT section_id FROM d GROUP BY section_id HAVING count(*) BETWEEN 2 AND 5) SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b USING (section_id) JOIN s USING (section_id) WHERE a.doc_id < b.doc_id"
)
def small_section_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the documents of a section, where it has at most five."""
    docs = table(spark, d, "documents").filter("section_id is not null").select("doc_id", "section_id").distinct()
    small = docs.groupBy("section_id").agg(F.count("*").alias("n")).filter(F.col("n").between(2, SMALL_SECTION)).select("section_id")
    a = docs.join(small, "section_id").withColumnRenamed("doc_id", "doc_a")
    return a.join(docs.withColumnRenamed("doc_id", "doc_b"), "section_id").filter("doc_a < doc_b").select("doc_a", "doc_b")


@query(
    _SIM
    + ", r AS (SELECT min(doc_id) AS doc, high, low FROM h GROUP BY high, low) SELECT least(a.doc, b.doc) AS doc_a, greatest(a.doc, b.doc) AS doc_b, CAST(bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) AS INTEGER) AS d FROM r a JOIN r b ON a.doc < b.doc WHERE bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= 3"
)
def simhash_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents, one for each hash, whose hashes are at most 3 bits apart: four blocks of 16 bits, one of which is equal."""
    whole = F.shiftleft("high", 32).bitwiseOR(F.col("low"))
    heads = catalog._simhashes(spark, d).groupBy(whole.alias("h")).agg(F.min("doc_id").alias("doc"))
    near = sketch.near_hashes(heads, "h", 3)
    side = lambda x: heads.select(F.col("h").alias(f"hash_{x}"), F.col("doc").alias(f"d{x}"))
    return near.join(side("a"), "hash_a").join(side("b"), "hash_b").select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"), "d")


_IMG = "ih AS (SELECT DISTINCT doc_id, image_hash FROM ocr_results WHERE image_hash <> ''), ig AS (SELECT image_hash, min(doc_id) AS first_doc, count(*) AS docs FROM ih GROUP BY image_hash HAVING count(*) > 1)"


@query(f"WITH {_IMG} SELECT doc_id, image_hash, first_doc, docs FROM ih JOIN ig USING (image_hash)")
def image_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a picture's hash: the group's first document and how many are in it."""
    own = table(spark, d, "ocr_results").filter("image_hash <> ''").select("doc_id", "image_hash").distinct()
    groups = own.groupBy("image_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("docs")).filter("docs > 1")
    return own.join(groups, "image_hash").select("doc_id", "image_hash", "first_doc", "docs")


_UNION = (
    _SH.rstrip()
    + ", "
    + _META.strip().removeprefix("WITH ").replace("s AS (", "ms AS (", 1).replace("FROM s)", "FROM ms)").replace("f AS (", "mf AS (", 1).replace("FROM f ", "FROM mf ").replace("FROM f)", "FROM mf)").replace("v AS (", "mv AS (", 1).replace("FROM v ", "FROM mv ").replace("g AS (", "mg AS (", 1)
    + ", tb AS (SELECT DISTINCT doc_id, strftime(extracted_at, '%Y-%m-%dT%H') AS bucket FROM documents WHERE extracted_at IS NOT NULL), tg AS (SELECT bucket, min(doc_id) AS first_doc FROM tb GROUP BY bucket), "
    + _IMG
    + """, cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM (SELECT DISTINCT doc_id, text FROM documents WHERE trim(text) <> '')),
ks AS (SELECT doc_a, doc_b, 1 AS rank, 'text' AS method FROM j UNION ALL SELECT first_doc, doc_id, 1, 'text' FROM cl
UNION ALL SELECT mg.first_doc, mv.doc_id, 2, 'metadata_fingerprint' FROM mv JOIN mg USING (kind, value) WHERE kind = 'software' UNION ALL SELECT tg.first_doc, tb.doc_id, 2, 'metadata_fingerprint' FROM tb JOIN tg USING (bucket)
UNION ALL SELECT mg.first_doc, mv.doc_id, 3, 'metadata' FROM mv JOIN mg USING (kind, value) WHERE kind <> 'software'
UNION ALL SELECT first_doc, doc_id, 4, 'image' FROM ih JOIN ig USING (image_hash) UNION ALL SELECT doc_a, doc_b, 4, 'image' FROM image_matches WHERE similarity >= 0.9),
c2 AS (SELECT doc_a, doc_b, method FROM (SELECT * FROM ks WHERE doc_a < doc_b) QUALIFY row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY rank) = 1)"""
)


def generated(spark: SparkSession, d: str) -> DataFrame:
    """(doc_a, doc_b, rank, method) of all generators. Groups of equal values give links to their first document: with these links every member of a group is reached, and none has all its pairs made."""
    docs = table(spark, d, "documents")
    link = lambda df, rank, method: df.select(F.col("first_doc").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(rank).alias("rank"), F.lit(method).alias("method"))
    pair = lambda df, rank, method: df.select("doc_a", "doc_b", F.lit(rank).alias("rank"), F.lit(method).alias("method"))
    meta = catalog.metadata_self_join(spark, d)
    hours = docs.filter("extracted_at is not null").select("doc_id", F.date_format("extracted_at", "yyyy-MM-dd'T'HH").alias("bucket")).distinct()
    hours = hours.join(hours.groupBy("bucket").agg(F.min("doc_id").alias("first_doc")), "bucket")
    rows = [
        pair(setjoin.near_duplicates(docs), 1, "text"),
        link(setjoin.text_classes(docs).withColumnRenamed("class_id", "first_doc"), 1, "text"),
        link(meta.filter("kind = 'software'"), 2, "metadata_fingerprint"),
        link(hours, 2, "metadata_fingerprint"),
        link(meta.filter("kind <> 'software'"), 3, "metadata"),
        link(image_hash_groups(spark, d), 4, "image"),
        pair(table(spark, d, "image_matches").filter("similarity >= 0.9"), 4, "image"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.filter("doc_a < doc_b")


@query(_UNION + " SELECT doc_a, doc_b, method FROM c2")
def candidate_union_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of all generators; a pair found by several keeps the first method."""
    return generated(spark, d).groupBy("doc_a", "doc_b").agg(F.min_by("method", "rank").alias("method"))


@query(_UNION + " SELECT method, count(*) AS pairs FROM c2 GROUP BY method")
def method_distribution(spark: SparkSession, d: str) -> DataFrame:
    return candidate_union_precedence(spark, d).groupBy("method").agg(F.count("*").alias("pairs"))


_FILTER = (
    _V
    + ", x AS (SELECT doc_id, i, avg(v) AS m FROM (SELECT doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM d) GROUP BY doc_id, i), u AS (SELECT doc_id, list(m ORDER BY i) AS v FROM x GROUP BY doc_id),"
    " c AS (SELECT doc_a, doc_b, max(similarity) AS s FROM image_matches GROUP BY doc_a, doc_b), f AS (SELECT c.*, CASE WHEN NOT isnan(list_cosine_similarity(a.v, b.v)) THEN list_cosine_similarity(a.v, b.v) END AS cosine FROM c LEFT JOIN u a ON a.doc_id = doc_a LEFT JOIN u b ON b.doc_id = doc_b)"
    " SELECT doc_a, doc_b, round(CASE WHEN cosine IS NULL THEN s WHEN s IS NULL THEN cosine ELSE greatest(s, cosine) END, 5) AS similarity FROM f WHERE cosine IS NULL OR cosine >= 0.30"
)


@query(_FILTER)
def vector_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs whose mean vectors have a cosine of 0.30 or more, or of which a vector is missing; the greater of the old similarity and the cosine stays."""
    means = catalog.document_vectors(spark, d).select("doc_id", vector_ops.unit(F.col("mean")).alias("v"))
    pairs = table(spark, d, "image_matches").groupBy("doc_a", "doc_b").agg(F.max("similarity").alias("s"))
    side = lambda x: means.select(F.col("doc_id").alias(f"doc_{x}"), F.col("v").alias(f"v_{x}"))
    rows = pairs.join(side("a"), "doc_a", "left").join(side("b"), "doc_b", "left").withColumn("cosine", vector_ops.dot(F.col("v_a"), F.col("v_b")))
    return rows.filter("cosine is null or cosine >= 0.30").select("doc_a", "doc_b", F.round(F.greatest("s", "cosine"), 5).alias("similarity"))


@query("SELECT doc_a, doc_b, round(max(similarity), 6) AS similarity FROM image_matches WHERE similarity IS NOT NULL GROUP BY doc_a, doc_b")
def candidates_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from the most to the least similar, ties by pair; a range-partitioned sort."""
    rows = table(spark, d, "image_matches").filter("similarity is not null").groupBy("doc_a", "doc_b").agg(F.round(F.max("similarity"), 6).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "doc_a", "doc_b")
