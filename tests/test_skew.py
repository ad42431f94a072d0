from bidloom.operators import skew


def test_spread_joins_equal_plain_joins(spark, monkeypatch):
    big = spark.createDataFrame([(k % 3 if k % 50 else None, k) for k in range(300)] + [(7, -1)], "key int, id int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d"), (None, "e")], "key int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, big.join(small, ["key"], how).collect()))
        assert sorted(map(str, skew.spread_join(big, small, ["key"], ["id"], how).collect())) == want
        assert sorted(map(str, skew.counted_join(big, small, ["key"], ["id"], how).collect())) == want
        monkeypatch.setattr(skew, "SMALL", 1)
        assert sorted(map(str, skew.counted_join(big, small, ["key"], ["id"], how).collect())) == want
        monkeypatch.setattr(skew, "SMALL", 50_000)
    assert skew.spread_join(big.limit(0), small, ["key"], ["id"]).count() == 0


def test_pairs_of_groups_are_whole_however_a_group_is_cut(spark):
    rows = [(k, i) for k, n in (("x", 1), ("y", 30), ("z", 2)) for i in range(n)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "key string, id int")
    want = sorted((k, i, j) for k, i in rows for m, j in rows if k == m and k and i < j)
    for most in (400, 7):
        assert sorted(tuple(r) for r in skew.grouped_pairs(df, ["key"], "id", most).collect()) == want
    assert skew.grouped_pairs(df.limit(0), ["key"], "id").count() == 0
