"""Exact set similarity join, near-duplicate classes and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.session import materialise

SHINGLE, SIMILAR = 5, 0.8


def shingles(texts: DataFrame, key: str, size: int = SHINGLE) -> DataFrame:
    """(key, item): 64-bit ids of the distinct runs of ``size`` lower-case words; texts with fewer words have none."""
    words = texts.select(key, F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).filter(F.size("w") >= size)
    runs = words.select(key, F.posexplode("w").alias("pos", "word"), F.size("w").alias("n"), "w").filter(F.col("pos") <= F.col("n") - size)
    return runs.select(key, F.xxhash64(F.array_join(F.slice("w", F.col("pos") + 1, size), " ")).alias("item")).distinct()


def similar_sets(items: DataFrame, key: str, least: float = SIMILAR) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of sets with a Jaccard similarity of at least ``least``. Exact.

    Prefix filter: with items ordered from rare to common, similar sets share one
    of their first |x| - ceil(least |x|) + 1 items, and sizes differ by the factor
    ``least`` at most. Only these items are joined, so common items make no pairs.
    """
    items = materialise(items)
    freq = items.groupBy("item").agg(F.count("*").alias("df"))
    order = Window.partitionBy(key).orderBy("df", "item")
    ranked = items.join(freq, "item").withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    keep = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    prefix = ranked.filter((F.col("place") <= keep) & (F.col("df") > 1)).select(key, "item", "n", "place")
    a = prefix.select(F.col(key).alias("a"), "item", F.col("n").alias("na"), F.col("place").alias("pa"))
    b = prefix.select(F.col(key).alias("b"), "item", F.col("n").alias("nb"), F.col("place").alias("pb"))
    # what is left after the shared item bounds the overlap
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    need = (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9
    close = (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9)
    pairs = a.join(b, "item").filter((F.col("a") < F.col("b")) & close & (most >= need)).select("a", "b", "na", "nb").distinct()
    left = pairs.join(items.withColumnRenamed(key, "a"), "a")
    both = left.join(items.withColumnRenamed(key, "b"), ["b", "item"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    jaccard = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return both.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= least - 1e-12)


def text_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents with equal texts form a class, named by its least document. Null and blank texts have none."""
    hashes = documents.filter(F.trim("text") != "").select("doc_id", F.md5("text").alias("h")).dropDuplicates(["doc_id"])
    heads = hashes.groupBy("h").agg(F.min("doc_id").alias("class_id"))
    return hashes.join(heads, "h").select("doc_id", "class_id")


def near_duplicates(documents: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_a, doc_b, jaccard): links between representatives of equal texts."""
    classes = text_classes(documents)
    heads = classes.filter("doc_id = class_id").select("doc_id")
    texts = documents.select("doc_id", "text").dropDuplicates(["doc_id"]).join(heads, "doc_id")
    return similar_sets(shingles(texts, "doc_id"), "doc_id", least).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard")
