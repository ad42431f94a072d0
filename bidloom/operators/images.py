"""Pictures: near hashes, texts in pictures, edited pictures and confusable words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import fixed, text
from bidloom.operators import sketch
from bidloom.operators.matching import jaccard


def near(ocr: DataFrame, distance: int = 9) -> DataFrame:
    """(hash_a, hash_b, d): different picture hashes at most ``distance`` bits apart, as hex digits. Hashes of another form are left out."""
    hashes = ocr.select(sketch.hex_bits(F.col("image_hash")).alias("h"))
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    rows = sketch.near_hashes(hashes, "h", distance).select(digits("hash_a").alias("a"), digits("hash_b").alias("b"), "d")
    return rows.select(F.least("a", "b").alias("hash_a"), F.greatest("a", "b").alias("hash_b"), "d")


def confidence(distance):
    """1 - d / 10, near ones raised; 0 from 10 bits on."""
    return F.when(distance <= 2, F.least(F.lit(0.95), 1 - distance / 10 + 0.2)).otherwise(F.greatest(F.lit(0.0), 1 - distance / 10))


def buckets(ocr: DataFrame) -> DataFrame:
    groups = ocr.filter("image_hash <> ''").groupBy("image_hash").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("ocr_id").alias("pictures"))
    bucket = F.when(F.col("docs") > 1, "shared").when(F.col("pictures") > 1, "repeated").otherwise("single")
    return groups.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("hashes"), F.sum("pictures").alias("pictures"))


def _pairs(matches: DataFrame, ocr: DataFrame) -> DataFrame:
    once = ocr.filter(F.length("text") >= 10).dropDuplicates(["ocr_id"]).select("ocr_id", "doc_id", "image_hash", F.length("text").alias("size"), "w", "h", text.tokens(F.col("text")).alias("words"))
    side = lambda x: once.select(*[F.col(c).alias("doc_" + x if c == "doc_id" else "ocr_" + x if c == "ocr_id" else f"{c}_{x}") for c in once.columns])
    rows = matches.select("doc_a", "doc_b").distinct().join(side("a"), "doc_a").join(side("b"), "doc_b")
    return rows.withColumn("jaccard", jaccard(F.col("words_a"), F.col("words_b")))


def text_pairs(matches: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pictures of candidate pairs of documents with like texts of 10 characters or more."""
    rows = _pairs(matches, ocr).filter("jaccard >= 0.80")
    return rows.select("doc_a", "doc_b", "ocr_a", "ocr_b", F.round("jaccard", 6).alias("jaccard"), F.when(F.col("jaccard") >= 0.92, "identical").otherwise("similar").alias("kind"))


def edited(matches: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pictures with hashes at most 10 bits apart and different texts, and like sizes or text lengths."""
    rows = _pairs(matches, ocr).filter("jaccard < 0.55").withColumn("dist", F.bit_count(sketch.hex_bits(F.col("image_hash_a")).bitwiseXOR(sketch.hex_bits(F.col("image_hash_b")))))
    ratio = lambda c: F.greatest(f"{c}_a", f"{c}_b") / F.least(f"{c}_a", f"{c}_b")
    same_size = F.coalesce((F.least("w_a", "w_b") > 0) & (ratio("w") <= 1.2) & (ratio("h") <= 1.2), F.lit(False))
    return rows.filter((F.col("dist") <= 10) & (same_size | (ratio("size") <= 1.5))).select("doc_a", "doc_b", "ocr_a", "ocr_b", "dist")


def confusable(matches: DataFrame, ocr: DataFrame) -> DataFrame:
    """Words of both documents of a pair that have one length and differ in one character of a confusable pair.

    Words with a confusable character are keyed by what is around it, so only such pairs are joined.
    """
    words = ocr.select("doc_id", F.explode("words").alias("word")).filter(F.length("word") >= 2).distinct()
    chars = "".join(fixed.CONFUSABLE)
    places = words.filter(F.col("word").rlike(f"[{chars}]")).select("doc_id", "word", F.posexplode(F.split("word", "")).alias("i", "c")).filter(F.col("c").rlike(f"[{chars}]") & (F.col("c") != ""))
    keyed = places.select("doc_id", "word", "c", F.concat(F.expr("substring(word, 1, i)"), F.lit("\x00"), F.expr("substring(word, i + 2)")).alias("key"))
    side = lambda x: keyed.select(F.col("doc_id").alias(f"doc_{x}"), F.col("word").alias(f"word_{x}"), F.col("c").alias(f"c_{x}"), "key")
    both = [p for x in fixed.CONFUSABLE for p in (x, x[::-1])]
    rows = matches.select("doc_a", "doc_b").distinct().join(side("a"), "doc_a").join(side("b"), ["doc_b", "key"]).filter(F.concat("c_a", "c_b").isin(both))
    return rows.select("doc_a", "doc_b", "word_a", "word_b").distinct()


def in_dimension(pictures: DataFrame, labels: DataFrame, dimension: str) -> DataFrame:
    """Pictures (doc_id, page_num) on pages of one label; those without a page pass."""
    own = labels.filter(F.col("label") == dimension).select("doc_id", F.col("page").alias("page_num"), F.lit(True).alias("_in"))
    return pictures.join(own, ["doc_id", "page_num"], "left").filter("_in or page_num is null").drop("_in")


def dimension_tags(pairs: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_a, doc_b, tag) of pairs of documents with a picture's page each (``pages``: doc_id, page)."""
    known = pages.join(labels.select("doc_id", "page", "label"), ["doc_id", "page"])
    side = lambda x: known.select(F.col("doc_id").alias(f"doc_{x}"), F.col("label").alias(x))
    rows = pairs.join(side("a"), "doc_a", "left").join(side("b"), "doc_b", "left")
    is_ = lambda x, v: F.coalesce(F.col(x) == v, F.lit(False))
    tag = F.when(is_("a", "technical") & is_("b", "technical"), "tech_image").when(is_("a", "commercial") & is_("b", "commercial"), "com_image")
    mixed = is_("a", "technical") & is_("b", "commercial") | is_("a", "commercial") & is_("b", "technical")
    return rows.select("doc_a", "doc_b", tag.when(mixed, "tech_image+com_image").otherwise("unknown").alias("tag"))


def allowed(ocr: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Pictures with a hash that isn't on the blacklist (image_hash)."""
    return ocr.filter("image_hash <> ''").join(blacklist.select("image_hash").distinct(), "image_hash", "left_anti")


def text_of_hash(ocr: DataFrame, size: int = 200) -> DataFrame:
    """(image_hash, text): of the pictures of each hash the first with a text, cut to ``size`` characters."""
    rows = ocr.filter("image_hash <> '' and text is not null")
    return rows.groupBy("image_hash").agg(F.min_by(F.substring("text", 1, size), "ocr_id").alias("text"))


def rare_words(pairs: DataFrame, words: DataFrame, dictionary: DataFrame, least: int = 4, shown: int = 10) -> DataFrame:
    """(doc_a, doc_b, words, n): words of ``dictionary`` of ``least`` characters or more, not all ASCII, that both documents have; two at least, the first ``shown``."""
    rare = dictionary.filter((F.length("w") >= least) & F.col("w").rlike(r"[^\x00-\x7F]"))
    own = words.join(rare, "w", "left_semi").distinct()
    side = lambda x: own.select(F.col("doc_id").alias(f"doc_{x}"), "w")
    both = pairs.select("doc_a", "doc_b").distinct().join(side("a"), "doc_a").join(side("b"), ["doc_b", "w"])
    return both.groupBy("doc_a", "doc_b").agg(F.slice(F.sort_array(F.collect_list("w")), 1, shown).alias("words"), F.count("*").alias("n")).filter("n >= 2")


def pair_buckets(pairs: DataFrame) -> DataFrame:
    """(exact, near, similar): how many matches (d, bits apart) are equal, at most 5 bits apart, and further apart."""
    return pairs.agg(F.count_if(F.col("d") == 0).alias("exact"), F.count_if((F.col("d") > 0) & (F.col("d") <= 5)).alias("near"), F.count_if(F.col("d") > 5).alias("similar"))
