"""Bounded samples that are fitted on, taken without sending more than about their size to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def sampled(rows: DataFrame, key: str, most: int) -> list[Row]:
    """The ``most`` rows with the least hashes of ``key`` and their keys, in that order; of a repeated key, one row.

    A count gives the hash below which rows are taken at all, so partitions send
    about ``most`` rows together, not each.
    """
    n = rows.count()
    kept = rows.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << 30)))
    if n > 2 * most:
        kept = kept.filter(F.col("_h") < int((1 << 30) * min(1.0, 1.5 * most / n)) + 1)
    got, seen = [], set()
    for r in kept.orderBy("_h", key).limit(2 * most).drop("_h").collect():
        if r[key] not in seen and len(got) < most:
            seen.add(r[key])
            got.append(r)
    return got
