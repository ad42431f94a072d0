"""Problem 2: how distinctive a listed term is of a pair of records.

Term frequency times smoothed logarithmic inverse document frequency. The
distinct (document, term) counts of the whole corpus are made once, by 64-bit ids
of the terms, and kept as a table; document frequencies and document lengths
are aggregated from them with partial aggregation, and the listed terms are
joined back to both.

Scale: a term in a third of all documents is pre-aggregated per task, so its
document frequency needs no hot group. The listed side of the join with the
counts is hashed, so the counts, the large side, aren't sorted. Two of V distinct
terms share an id with probability V**2 / 2**65, 3e-8 for a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.operators.skew import counted_join
from bidloom.session import materialise

MAX_DOCS = 5


def term(word: Column) -> Column:
    """Lower-cased, without the non-letters at both ends."""
    low = F.lower(word)
    clean = low.rlike(r"^\p{L}(.*\p{L})?$")
    return F.when(clean, low).otherwise(F.regexp_replace(low, r"(?s)^[^\p{L}]+|[^\p{L}]+$", ""))


def corpus_counts(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, id, tf): in how many of a document's paragraphs a term is. Null tokens, and tokens without letters, don't count."""
    once = paragraphs.select("para_id", "doc_id", "tokens").dropDuplicates(["para_id"])
    words = once.select("doc_id", F.explode("tokens").alias("word")).select("doc_id", term(F.col("word")).alias("term"))
    return words.filter("term <> ''").select("doc_id", F.xxhash64("term").alias("id")).groupBy("doc_id", "id").agg(F.count("*").alias("tf"))


def listed_terms(matches: DataFrame) -> DataFrame:
    """(match_id, doc_a, doc_b, term): the distinct listed terms of each match."""
    words = matches.select("match_id", "doc_a", "doc_b", F.explode("shared_rare_words").alias("word"))
    return words.select("match_id", "doc_a", "doc_b", term(F.col("word")).alias("term")).filter("term <> ''").distinct()


def term_scores(matches: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(match_id, term, tf_a, tf_b, docs, score) of each listed term.

    The score is the mean over both documents of tf / length, times
    ln((N + 1) / (docs + 1)) + 1, where N counts the documents with terms and a
    document's length is the sum of its tf. A term that a document lacks has
    tf 0 there; one that no document has gets docs 0. Repeated matches and
    repeated entries count once, null and empty lists give no rows.
    """
    counts = materialise(corpus_counts(paragraphs))
    docs = counts.groupBy("id").agg(F.count("*").alias("docs"))
    length = counts.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    listed = listed_terms(matches)
    sides = listed.select("match_id", "term", F.inline(F.array(*[F.struct(F.col(f"doc_{x}").alias("doc_id"), F.lit(x).alias("side")) for x in "ab"])))
    sides = sides.select("*", F.xxhash64("term").alias("id"))
    tf = counts.join(sides.hint("shuffle_hash"), ["doc_id", "id"]).select("match_id", "term", "side", "doc_id", "tf")
    tf = tf.join(length, "doc_id").groupBy("match_id", "term").pivot("side", ["a", "b"]).agg(F.first("tf").alias("tf"), F.first("length").alias("length"))
    total = length.agg(F.count("*").alias("n"))
    share = lambda x: F.coalesce(F.col(f"{x}_tf") / F.col(f"{x}_length"), F.lit(0.0))
    # a word that is listed everywhere is a hot key here; the counts of the listed words are few
    named = listed.select("match_id", "term", F.xxhash64("term").alias("id"))
    known = materialise(docs.join(named.select("id").distinct(), "id", "left_semi"))
    rows = counted_join(named, known, ["id"], ["match_id", "term"], "left").join(tf, ["match_id", "term"], "left").join(F.broadcast(total))
    docs_of = F.coalesce("docs", F.lit(0))
    return rows.select(
        "match_id",
        "term",
        F.coalesce("a_tf", F.lit(0)).alias("tf_a"),
        F.coalesce("b_tf", F.lit(0)).alias("tf_b"),
        docs_of.alias("docs"),
        F.round((share("a") + share("b")) / 2 * (F.log((F.col("n") + 1) / (docs_of + 1)) + 1), 9).alias("score"),
    )


def found(matches: DataFrame, paragraphs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(match_id, term): listed terms of both documents that at most ``max_docs`` documents hold."""
    return term_scores(matches, paragraphs).filter((F.col("tf_a") > 0) & (F.col("tf_b") > 0) & (F.col("docs") <= max_docs)).select("match_id", "term")
