import re

from bidloom.llm import queries


def test_every_problem_has_a_query():
    assert {int(re.match(r"p(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert {f"p{n}_found" for n in range(1, 11)} - set(queries.QUERIES) == {"p8_found", "p9_found"}


def test_queries_run_on_the_smallest_data(spark, data):
    for name in ("p1_blocks", "p3_shared_parts", "p9_usage", "p8_round_trip", "p10_shares", "p5_entities"):
        assert queries.QUERIES[name](spark, data).count() >= 0


def test_containers_of_real_lengths_are_nearly_full(spark):
    got = {r["capacity"]: (r["fill"], r["fullest"]) for r in queries.p9_usage(spark, "/root/testdata/sf0.01").collect()}
    specs = {r["capacity"] for r in spark.read.parquet("/root/testdata/sf0.01/container_specs.parquet").collect()}
    assert set(got) == specs and all(fill > 0.98 and fullest <= cap for cap, (fill, fullest) in got.items() if cap <= 8192), got
