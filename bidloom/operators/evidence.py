"""Evidence of pairs of documents, and what companies of a request get to see of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids and values that a verdict lists at most.
SHOWN = 20


def flagged(pairs: DataFrame, kinds: dict[str, DataFrame], use: list[str] | None = None) -> DataFrame:
    """(doc_a, doc_b, one boolean for each kind, has_evidence): whether a pair is among each kind's pairs.

    ``use`` switches kinds on by name: a kind that is off is left out of the plan,
    not only of the result. Null ids match nothing; repeated pairs count once.
    """
    names = [k for k in kinds if use is None or k in use]
    rows = pairs.select("doc_a", "doc_b").distinct()
    for k in names:
        rows = rows.join(kinds[k].select("doc_a", "doc_b").distinct().withColumn(k, F.lit(True)), ["doc_a", "doc_b"], "left")
    flags = [F.coalesce(F.col(k), F.lit(False)) for k in names]
    any_of = reduce(lambda a, b: a | b, flags, F.lit(False))
    return rows.select("doc_a", "doc_b", *[f.alias(k) for f, k in zip(flags, names, strict=True)], any_of.alias("has_evidence"))


def sharing(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs of documents that share a row of ``values`` (doc_id, then what must be equal). Only given pairs are looked at, so common values make no pairs."""
    rest = [c for c in values.columns if c != "doc_id"]
    side = lambda x: values.withColumnRenamed("doc_id", f"doc_{x}")
    return pairs.select("doc_a", "doc_b").distinct().join(side("a"), "doc_a").join(side("b"), ["doc_b", *rest]).select("doc_a", "doc_b").distinct()


def mates(rows: DataFrame, item: str, by: list[str], shown: int = SHOWN) -> DataFrame:
    """``rows`` with ``mates`` (the least other items of the same ``by``, at most ``shown``) and ``n_mates`` (how many others).

    Of a group only its first items are gathered, however large it is; a null
    value of ``by`` is in no group.
    """
    known = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])).select(item, *by).distinct()
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(item))).filter(F.col("_n") <= shown + 1)
    heads = first.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_first"))
    groups = known.groupBy(*by).agg(F.count("*").alias("_size")).join(heads, by)
    other = F.slice(F.filter("_first", lambda x: x != F.col(item)), 1, shown)
    empty = F.array().cast(f"array<{dict(rows.dtypes)[item]}>")
    return rows.join(groups, by, "left").withColumn("mates", F.coalesce(other, empty)).withColumn("n_mates", F.coalesce(F.col("_size") - 1, F.lit(0))).drop("_first", "_size")


def or_error(verdicts: DataFrame, request: list[str], failed: Column, stage: str) -> DataFrame:
    """Verdicts in which one row that ``failed`` turns all rows of its request into ERROR, with the stage that failed."""
    bad = verdicts.withColumn("_bad", F.coalesce(failed, F.lit(False))).groupBy(*request).agg(F.max("_bad").alias("_any"))
    rows = verdicts.join(bad.select(*[F.col(c).alias(f"_{c}") for c in request], "_any"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in request]), "left")
    return rows.withColumn("status", F.when(F.col("_any"), "ERROR").otherwise(F.col("status"))).withColumn("stage", F.when(F.col("_any"), stage)).drop("_any", *[f"_{c}" for c in request])
