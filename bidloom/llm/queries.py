"""The pN_ queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import names, packing, personal, repeated_lines, repetition, scans, shared_spans, term_weights, tokenize, vectors
from bidloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.found(table(spark, d, "paragraphs"), table(spark, d, "documents"))


@query
def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.blocks_report(table(spark, d, "paragraphs"), table(spark, d, "documents"))


@query
def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.cleaned(table(spark, d, "paragraphs"), table(spark, d, "documents"))


_P1 = r"""
WITH s AS (SELECT DISTINCT doc_id, coalesce(source, '') AS source FROM documents),
p AS (SELECT DISTINCT p.para_id, p.doc_id, p.text, s.source FROM paragraphs p JOIN s USING (doc_id)),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM p GROUP BY source),
x AS (SELECT para_id, doc_id, source, string_split(text, chr(10)) AS ls FROM p WHERE text IS NOT NULL),
l AS (SELECT para_id, doc_id, source, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM x),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM l),
f AS (SELECT source, k, count(DISTINCT doc_id) AS docs FROM k WHERE k <> '' GROUP BY source, k),
b AS (SELECT source, k FROM f JOIN n USING (source) WHERE docs >= 3 AND docs >= 0.2 * n)
"""
ORACLE["p1_found"] = _P1 + "SELECT DISTINCT para_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN b USING (source, k)"
ORACLE["p1_blocks"] = (
    _P1
    + """, i AS (SELECT para_id, any_value(para_index) AS para_index FROM paragraphs GROUP BY para_id),
o AS (SELECT DISTINCT k.source, k.doc_id, k.para_id, k.line_no, k.k, i.para_index FROM k JOIN i USING (para_id) WHERE k.k <> ''),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_index NULLS FIRST, para_id, line_no) AS pos FROM o),
v AS (SELECT q.*, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM q JOIN b USING (source, k)),
r AS (SELECT source, doc_id, list(k ORDER BY pos) AS ks FROM v GROUP BY source, doc_id, run),
a AS (SELECT source, doc_id, ks, unnest(range(1, len(ks) + 1)) AS i FROM r), e AS (SELECT source, doc_id, ks, i, unnest(range(i, len(ks) + 1)) AS j FROM a),
g AS (SELECT source, j - i + 1 AS size, array_to_string(ks[i:j], chr(10)) AS block, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1, 2, 3)
SELECT source, CAST(size AS INTEGER) AS size, count(*) AS blocks, max(docs) AS docs_max FROM g JOIN n USING (source) WHERE docs >= 3 AND docs >= 0.2 * n GROUP BY 1, 2"""
)
ORACLE["p1_cleaned"] = (
    _P1
    + """, g AS (SELECT k.para_id, list(DISTINCT line_no) AS gone FROM k JOIN b USING (source, k) GROUP BY k.para_id),
t AS (SELECT DISTINCT para_id, doc_id, text FROM paragraphs)
SELECT para_id, doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda l, i : NOT list_contains(gone, i - 1)), chr(10)) END AS text,
CAST(coalesce(len(gone), 0) AS INTEGER) AS lines_removed FROM t LEFT JOIN g USING (para_id)"""
)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.found(table(spark, d, "paragraphs"))


@query
def p3_shared_parts(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_parts(table(spark, d, "paragraphs"), table(spark, d, "documents"))


_P3 = """
WITH p AS (SELECT DISTINCT para_id, doc_id, text FROM paragraphs WHERE length(text) >= 200),
w AS (SELECT para_id, doc_id, i, substr(text, i, 200) AS s FROM (SELECT para_id, doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM p)),
t AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)), v AS (SELECT w.* FROM w JOIN t USING (s))
"""
ORACLE["p3_found"] = _P3 + "SELECT DISTINCT a.para_id AS para_a, b.para_id AS para_b FROM v a JOIN v b USING (s) WHERE a.para_id < b.para_id AND a.doc_id <> b.doc_id"
ORACLE["p3_shared_parts"] = (
    _P3.replace("WITH p", "WITH RECURSIVE p")
    + """, l(n, para_id, doc_id, i, s) AS (SELECT CAST(200 AS BIGINT), para_id, doc_id, i, s FROM v UNION ALL SELECT 2 * n, para_id, doc_id, i, s FROM (
  SELECT n, para_id, doc_id, i, s, min(doc_id) OVER (PARTITION BY s) AS lo, max(doc_id) OVER (PARTITION BY s) AS hi FROM (SELECT a.n, a.para_id, a.doc_id, a.i, a.s || b.s AS s FROM l a JOIN l b ON a.para_id = b.para_id AND b.i = a.i + a.n)) WHERE lo < hi),
m AS (SELECT doc_id, max(n) AS longest FROM l GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(least(200, i - lag(i) OVER (PARTITION BY para_id ORDER BY i)), 200) AS k FROM v), k AS (SELECT doc_id, sum(k) AS shared_chars FROM c GROUP BY doc_id),
o AS (SELECT doc_id, sum(length(text)) AS own FROM (SELECT DISTINCT para_id, doc_id, text FROM paragraphs) GROUP BY doc_id), t2 AS (SELECT doc_id, any_value(total_text_length) AS n FROM documents GROUP BY doc_id)
SELECT doc_id, CAST(shared_chars AS BIGINT) AS shared_chars, CAST(longest AS INTEGER) AS longest, CAST(CASE WHEN t2.n > 0 THEN t2.n ELSE own END AS BIGINT) AS total_chars,
round(least(1.0::DOUBLE, shared_chars / CASE WHEN t2.n > 0 THEN t2.n ELSE own END), 6) AS share FROM k JOIN o USING (doc_id) LEFT JOIN t2 USING (doc_id) JOIN m USING (doc_id)"""
)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.found(table(spark, d, "documents"))


@query
def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(table(spark, d, "documents"))


ORACLE["p10_found"] = r"""
WITH l AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^\p{L}]+', '', 'g') AS x FROM documents),
w AS (SELECT doc_id, length(x) AS n, i, substr(x, i, 40) AS s FROM (SELECT doc_id, x, unnest(range(1, length(x) - 38)) AS i FROM l WHERE length(x) > 40)),
r AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, min(i) OVER (PARTITION BY doc_id, s) AS first FROM w) WHERE i > first),
c AS (SELECT doc_id, n, least(40, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 40)) AS k FROM r)
SELECT doc_id FROM c GROUP BY doc_id HAVING sum(k) >= 0.3 * any_value(n)"""


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_weights.found(table(spark, d, "image_matches"), table(spark, d, "paragraphs"))


@query
def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return term_weights.term_scores(table(spark, d, "image_matches"), table(spark, d, "paragraphs"))


_P2 = r"""
WITH w AS (SELECT doc_id, regexp_replace(regexp_replace(lower(w), '^[^\p{L}]+', ''), '[^\p{L}]+$', '') AS term FROM (SELECT doc_id, unnest(tokens) AS w FROM (SELECT para_id, any_value(doc_id) AS doc_id, any_value(tokens) AS tokens FROM paragraphs GROUP BY para_id))),
c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS docs FROM c GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM c),
g AS (SELECT doc_id, sum(tf) AS length FROM c GROUP BY doc_id),
m AS (SELECT DISTINCT match_id, doc_a, doc_b, regexp_replace(regexp_replace(lower(w), '^[^\p{L}]+', ''), '[^\p{L}]+$', '') AS term
  FROM (SELECT match_id, doc_a, doc_b, unnest(shared_rare_words) AS w FROM image_matches)),
s AS (SELECT m.match_id, m.term, coalesce(a.tf, 0) AS tf_a, coalesce(b.tf, 0) AS tf_b, coalesce(f.docs, 0) AS docs,
  round((coalesce(a.tf / ga.length, 0) + coalesce(b.tf / gb.length, 0)) / 2 * (ln((n.n + 1) / (coalesce(f.docs, 0) + 1)) + 1), 9) AS score
  FROM m LEFT JOIN c a ON a.doc_id = m.doc_a AND a.term = m.term LEFT JOIN c b ON b.doc_id = m.doc_b AND b.term = m.term
  LEFT JOIN g ga ON ga.doc_id = m.doc_a LEFT JOIN g gb ON gb.doc_id = m.doc_b LEFT JOIN f ON f.term = m.term, n WHERE m.term <> '')
"""
ORACLE["p2_found"] = _P2 + "SELECT match_id, term FROM s WHERE tf_a > 0 AND tf_b > 0 AND docs <= 5"
ORACLE["p2_scores"] = _P2 + "SELECT * FROM s"


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


@query
def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's size in tokens, and whether decoding them gives the text again."""
    texts = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"])
    tokens = tokenize.encode(texts)
    sizes = tokens.select("doc_id", F.size("ids").alias("n_tokens"))
    again = tokenize.decode(tokens).select("doc_id", F.xxhash64("text").alias("again"))
    return texts.select("doc_id", F.xxhash64("text").alias("is")).join(again, "doc_id").join(sizes, "doc_id").select("doc_id", "n_tokens", (F.col("is") == F.col("again")).alias("same"))


@query
def p9_filled(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(tokenize.token_counts(table(spark, d, "documents")), table(spark, d, "container_specs"))


@query
def p9_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p9_filled(spark, d), table(spark, d, "container_specs"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.found(table(spark, d, "text_embedding_cache"))


ORACLE["p6_found"] = """
WITH e AS (SELECT vec_id, any_value(embedding)::DOUBLE[] AS v FROM text_embedding_cache WHERE len(embedding) = 384 AND NOT list_contains(list_transform(embedding, lambda x : isnan(x)), true) GROUP BY vec_id),
u AS (SELECT * FROM e WHERE list_sum(list_transform(v, lambda x : x * x)) > 0), s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10) SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t WHERE c >= 0.80"""


@query
def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of all vectors, for the vectors whose id is divisible by 100."""
    return vectors.neighbours(table(spark, d, "text_embedding_cache"), F.col("vec_id") % 100 == 0)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "companies"), table(spark, d, "contact_fingerprints"), table(spark, d, "name_aliases"))


@query
def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "companies"), table(spark, d, "contact_fingerprints"), table(spark, d, "name_aliases"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "ocr_results"), table(spark, d, "documents"), table(spark, d, "paragraphs"))


@query
def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "ocr_results"), table(spark, d, "documents"), table(spark, d, "paragraphs"))


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "paragraphs"), table(spark, d, "contact_fingerprints"), table(spark, d, "name_aliases")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(*_personal(spark, d))


@query
def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(*_personal(spark, d))
