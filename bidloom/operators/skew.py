"""Joins that keep a hot key from becoming one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted side is sent to every task.
SMALL = 50_000
#: Parts that each key of a larger side is split into.
SALTS = 8


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], row: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``big`` joined with ``small`` (few rows a key), the rows of each key of ``big`` spread over ``salts`` tasks by the hash of ``row``.

    The result equals ``big.join(small, keys, how)`` for inner, left, left_semi and left_anti joins.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], row: list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """``spread_join``, or a broadcast if the written table ``small`` has at most ``most`` rows; the rows are counted first."""
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), keys, how)
    return spread_join(big, small, keys, row, how)


def grouped_pairs(rows: DataFrame, keys: list[str], item: str, most: int = 400) -> DataFrame:
    """(*keys, a, b), a < b: the pairs of distinct items of each group, for results that are pairs by definition.

    ``rows`` should be written: it is read twice. Groups of one item go first. A
    group of more than ``most`` items is cut into parts: each item meets the group
    in the task of its own part, so no task holds all pairs of a group.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    sized = rows.join(sizes, keys).withColumn("_parts", F.ceil(F.col("_n") / most).cast("int"))
    left = sized.select(*keys, F.col(item).alias("a"), F.pmod(F.xxhash64(item), F.col("_parts")).cast("int").alias("_part"))
    right = sized.select(*keys, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, [*keys, "_part"]).filter("a < b").select(*keys, "a", "b")
