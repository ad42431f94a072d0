from bidloom.streaming import ingest


def test_later_documents_meet_stored_ones(spark, tmp_path):
    schema = "para_id long, doc_id long, tokens array<string>"
    words = [f"word{i}" for i in range(40)]
    for k, rows in enumerate([[(1, 1, words), (2, 2, ["other", "words"])], [(3, 3, words), (4, 4, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "store/pairs"))
    assert {(r["doc_a"], r["doc_b"]) for r in got.collect()} == {(1, 3)}
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "store/bands")).select("doc_id").collect()} == {1, 2, 3}


def test_recall_of_pairs_at_the_threshold(spark):
    import random

    rng = random.Random(3)
    rows, want = [], 0
    for k in range(150):
        common = [f"c{k}x{i}" for i in range(24)]
        own = lambda s: [f"{s}{k}x{i}" for i in range(11)]  # noqa: E731, B023
        rows += [(2 * k, common + own("a")), (2 * k + 1, common + own("b"))]
    rng.shuffle(rows)
    from bidloom.operators import sketch
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").select("doc_id", F.explode("tokens").alias("token"))
    sigs = sketch.minhash(df, "doc_id").cache()
    sig = {r["doc_id"]: r["sig"] for r in sigs.collect()}
    want = {(2 * k, 2 * k + 1) for k in range(150) if sum(x == y for x, y in zip(sig[2 * k], sig[2 * k + 1], strict=True)) >= 16}
    got = {(r["doc_a"], r["doc_b"]) for r in ingest.pairs(sigs, None).collect()}
    assert want and len(want & got) >= 0.95 * len(want)


def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "store/bands").mkdir(parents=True)
    (tmp_path / "store/bands/part.parquet").write_text("no table")
    spark.createDataFrame([(1, 1, ["a", "b"])], "para_id long, doc_id long, tokens array<string>").write.parquet(str(tmp_path / "in"))
    stream = ingest.start(spark, str(tmp_path / "in"), "para_id long, doc_id long, tokens array<string>", str(tmp_path / "store"), str(tmp_path / "check"))
    try:
        stream.awaitTermination()
        raise AssertionError("no error")
    except Exception as e:  # noqa: BLE001
        assert "no error" not in str(e)
