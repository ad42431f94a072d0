import hashlib
import random

from pyspark.sql import functions as F

from bidloom.operators import graph, images, matching, setjoin, sketch, vectors
from bidloom.sources import store


def test_minhash_equals_the_definition(spark):
    rows = [(1, "alpha"), (1, "beta"), (1, "beta"), (2, "gamma")]
    got = {r[0]: r[1] for r in sketch.minhash(spark.createDataFrame(rows, "k long, token string"), "k").collect()}
    low = lambda w, i: int(hashlib.md5(f"{w}:{i}".encode()).hexdigest(), 16) % 2**32
    assert got[1] == [min(low("alpha", i), low("beta", i)) for i in range(32)] and got[2] == [low("gamma", i) for i in range(32)]


def test_simhash_equals_the_definition(spark):
    rows = [(1, "alpha", 2), (1, "beta", 1)]
    r = sketch.simhash(spark.createDataFrame(rows, "k long, token string, tf long"), "k").first()
    sums = [0] * 64
    for _, w, tf in rows:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16) & (2**64 - 1)
        for b in range(64):
            sums[b] += tf if h >> b & 1 else -tf
    assert (r["high"] << 32) + r["low"] == sum(1 << b for b in range(64) if sums[b] > 0)


def test_near_hashes_lose_none(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(30)]
    hs = base + [h ^ sum(1 << b for b in rng.sample(range(63), k)) for h in base for k in (1, 5, 9, 10, 12)]
    got = {tuple(r) for r in sketch.near_hashes(spark.createDataFrame([(h,) for h in hs], "h long"), "h", 9).collect()}
    want = {(min(a, b), max(a, b), (a ^ b).bit_count()) for a in set(hs) for b in set(hs) if a < b and (a ^ b).bit_count() <= 9}
    assert got == want


def test_set_join_equals_all_pairs(spark):
    rng = random.Random(2)
    sets = {k: {rng.randrange(60) for _ in range(rng.randint(3, 20))} for k in range(60)}
    for k in range(60, 90):
        sets[k] = set(sets[k - 60])
        sets[k].discard(min(sets[k]))
    rows = [(k, v) for k, s in sets.items() for v in s]
    got = {(r[0], r[1]) for r in setjoin.similar_sets(spark.createDataFrame(rows, "k long, item long"), "k").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert got == want and want


def test_near_duplicates_of_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long), (3, long + " tail"), (4, None), (5, ""), (6, "  "), (7, "too short"), (3, long + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r)[:2] for r in setjoin.near_duplicates(docs).collect()] == [(1, 3)]
    assert {tuple(r) for r in setjoin.text_classes(docs).collect()} == {(1, 1), (2, 1), (3, 3), (7, 7)}
    assert setjoin.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(None, 5), (7, 7), (200, 200)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 200: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_and_blocks(spark):
    rows = [(1, 2, i, i, 1.0, i, i) for i in (0, 1, 2, 5, 6, 9)]
    m = spark.createDataFrame(rows, "doc_a long, doc_b long, index_a int, index_b int, similarity double, para_a long, para_b long")
    assert [tuple(r)[2:6] for r in matching.runs(m, 1, 1, 3).collect()] == [(1, 0, 2, 3)]
    assert [tuple(r)[2:6] for r in matching.runs(m, 2, 2, 2).orderBy("run").collect()] == [(1, 0, 2, 3), (2, 5, 6, 2)]


def test_vector_search_and_usable(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(1, 30)] + [(100, [0.0, 1.0, 2.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.search(t, F.col("vec_id") == 100, 3).orderBy(F.desc("cosine")).collect()
    assert len(got) == 3 and all(r["query_id"] == 100 and r["vec_id"] != 100 for r in got)
    odd = spark.createDataFrame([([1.0, float("nan")],), ([1.0],), (None,), ([1.0, None],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in odd.select(vectors.usable(F.col("v"), 2)).collect()][-1] is True
    assert odd.filter(vectors.usable(F.col("v"), 2)).count() == 1


def test_confusable_words(spark):
    m = spark.createDataFrame([(1, 2)], "doc_a long, doc_b long")
    o = spark.createDataFrame([(1, ["日期", "己方", "same"]), (2, ["曰期", "已方", "same", "月期"])], "doc_id long, words array<string>")
    assert {tuple(r)[2:] for r in images.confusable(m, o).collect()} == {("日期", "曰期"), ("己方", "已方")}


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k long, v string")
    assert sorted(tuple(r) for r in store.inserted(a, b, ["k"]).collect()) == [(1, "x"), (2, "y"), (3, "w")]
    (tmp_path / "a.pdf").write_bytes(b"x" * 9000)
    (tmp_path / "a.txt").write_bytes(b"x")
    got = store.files(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["digest"] == hashlib.md5(b"x" * 4096).hexdigest()
    store.write_report(a, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
