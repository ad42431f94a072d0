import random

import numpy as np
from pyspark.sql import functions as F

from bidloom.functions import pictures
from bidloom.operators import images, sketch

O = "ocr_id long, doc_id long, page_num int, image_hash string, text string, words array<string>, w int, h int"


def ocr(spark):
    text = "payment terms of the northern bridge project apply"
    return spark.createDataFrame(
        [
            (1, 1, 1, "00000000000000ff", text, ["末日", "合同"], 800, 600),
            (2, 2, 1, "00000000000000f0", text, ["未日", "合同"], 800, 600),
            (3, 2, 2, "ffffffffffffffff", "an entirely different text is printed here today", None, 800, 610),
            (4, 1, 2, "fffffffffffffff0", "other words stand on this sheet of paper instead", [], 810, 600),
            (5, 3, 1, None, None, None, None, None),
            (5, 3, 1, None, None, None, None, None),
            (6, 3, None, "bad", "short", ["x"], 0, 0),
        ],
        O,
    )


def matches(spark):
    return spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "doc_a long, doc_b long")


def test_near_hashes_of_pictures(spark):
    got = {tuple(r) for r in images.near(ocr(spark)).collect()}
    assert got == {("00000000000000f0", "00000000000000ff", 4), ("fffffffffffffff0", "ffffffffffffffff", 4)}
    assert images.near(ocr(spark).limit(0)).count() == 0
    assert tuple(images.pair_buckets(images.near(ocr(spark))).first()) == (0, 2, 0)


def test_near_hashes_equal_brute_force_at_every_distance(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    made = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 14))) for b in base for _ in range(6)} | set(base)
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in made]
    df = spark.createDataFrame(rows + rows[:3] + [(None,)], "h long")
    for distance in (0, 3, 5, 6, 9, 12):
        want = {tuple(sorted(p)) for p in ((a[0], b[0]) for a in rows for b in rows) if p[0] < p[1] and bin((p[0] ^ p[1]) & ((1 << 64) - 1)).count("1") <= distance}
        assert {(r["hash_a"], r["hash_b"]) for r in sketch.near_hashes(df, "h", distance).collect()} == want


def test_pictures_with_like_texts_edited_ones_and_confusable_words(spark):
    m, o = matches(spark), ocr(spark)
    assert {(r["ocr_a"], r["ocr_b"], r["kind"]) for r in images.text_pairs(m, o).collect()} == {(1, 2, "identical")}
    assert {(r["ocr_a"], r["ocr_b"], r["dist"]) for r in images.edited(m, o).collect()} == {(4, 3, 4)}
    assert {(r["doc_a"], r["word_a"], r["word_b"]) for r in images.confusable(m, o.withColumn("words", F.array(F.when(F.col("doc_id") == 2, "曰子").otherwise("日子"), F.lit("other")))).collect()} == {(1, "日子", "曰子")}
    for f in (images.text_pairs, images.edited, images.confusable):
        assert f(m.limit(0), o).count() == 0 and f(m, o.limit(0)).count() == 0


def test_pictures_by_part_of_the_document(spark):
    labels = spark.createDataFrame([(1, 1, "technical"), (2, 1, "commercial"), (2, 2, "technical"), (3, 1, "technical")], "doc_id long, page int, label string")
    assert {r["ocr_id"] for r in images.in_dimension(ocr(spark), labels, "technical").collect()} == {1, 3, 5, 6}
    pages = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, page int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "doc_a long, doc_b long")
    assert {tuple(r) for r in images.dimension_tags(pairs, pages, labels).collect()} == {(1, 2, "tech_image+com_image"), (1, 3, "tech_image"), (2, 9, "unknown")}
    black = spark.createDataFrame([("bad",), (None,)], "image_hash string")
    assert "bad" not in {r["image_hash"] for r in images.allowed(ocr(spark), black).collect()}


def test_perceptual_hash_survives_scaling_and_sees_other_pictures():
    rng = np.random.default_rng(2)
    small = rng.integers(0, 255, (16, 16)).astype(np.uint8)
    one, two = np.repeat(np.repeat(small, 8, 0), 8, 1), np.repeat(np.repeat(small, 4, 0), 4, 1)
    other = rng.integers(0, 255, (128, 128)).astype(np.uint8)
    h = lambda a: int(pictures.perceptual_hash(a.tobytes(), a.shape[1], a.shape[0]), 16)
    assert bin(h(one) ^ h(two)).count("1") <= 2 < 12 < bin(h(one) ^ h(other)).count("1")
    assert pictures.perceptual_hash(None, 3, 3) is None and pictures.perceptual_hash(b"12", 3, 3) is None and pictures.perceptual_hash(b"1" * 9, 3, 3)
    filled = pictures.without_text(bytes([9] * 100), 10, 10, [(2, 2, 5, 5), (-5, 0, 20, 1)])
    assert set(filled) == {9} and pictures.without_text(None, 1, 1, []) is None


def test_histograms_verify_matches():
    red, blue = pictures.colour_histogram(bytes([250, 0, 0] * 9)), pictures.colour_histogram(bytes([0, 0, 250] * 9))
    assert abs(sum(red) - 3) < 1e-9 and pictures.colour_histogram(b"") is None
    assert pictures.verified(red, red, 0.8) == 0.8 and pictures.verified(red, blue, 0.8) == 0 and pictures.verified(None, red, 0.8) == 0.8


def test_boxes_are_merged_until_none_are_near():
    boxes = [[0, 0, 10, 10], [18, 0, 30, 10], [36, 0, 50, 10], [200, 200, 210, 210], None]
    assert pictures.merge_boxes(boxes, 8) == [[0, 0, 50, 10], [200, 200, 210, 210]] and pictures.merge_boxes(None) == [] and pictures.merge_boxes([[0, 0, 1, 1]] * 3) == [[0, 0, 1, 1]]


def test_hash_of_pictures_in_a_table(spark):
    df = spark.createDataFrame([(1, bytearray(range(100)), 10, 10, [[0.0, 0.0, 1.0, 1.0], [2.0, 0.0, 3.0, 1.0]]), (2, None, None, None, None)], "id long, pixels binary, w int, h int, boxes array<array<double>>")
    rows = df.select("id", pictures.perceptual_hash_of("pixels", "w", "h").alias("hash"), pictures.colour_histogram_of("pixels").alias("c"), pictures.merged_boxes("boxes").alias("b")).orderBy("id").collect()
    assert len(rows[0]["hash"]) == 16 and len(rows[0]["c"]) == 24 and rows[0]["b"] == [[0.0, 0.0, 3.0, 1.0]] and rows[1]["hash"] is None and rows[1]["b"] == []
