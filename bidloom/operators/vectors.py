"""Vectors: usability, means and search of a stated set of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(v: Column, size: int) -> Column:
    """Of ``size`` values, none null or NaN."""
    return (F.size(v) == size) & ~F.exists(v, lambda x: F.isnan(x) | x.isNull())


def mean(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, vectors, mean): the mean vector of each key, summed as vectors with partial aggregation."""
    v = array_to_vector(F.col(column).cast("array<double>"))
    return rows.groupBy(key).agg(F.count("*").alias("vectors"), vector_to_array(Summarizer.mean(v)).alias("mean"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def unit(v: Column) -> Column:
    """The vector at unit length, in double precision; null if it has none."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))


def _best(k: int):
    """Of a block of queries and of vectors: each query's k nearest, by one product of matrices."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        lists = table.column("v").combine_chunks()
        m = lists.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q) if len(x) else 0, 512):
            part = q[a : a + 512]
            score = m[part] @ m[x].T
            score[ids[part][:, None] == ids[x][None]] = -np.inf
            kept = min(k, len(x))
            least = np.partition(score, len(x) - kept, axis=1)[:, len(x) - kept, None]
            row, col = np.nonzero((score >= least) & (score > -np.inf))
            for o, v in zip(out, (ids[part][row], ids[x][col], score[row, col]), strict=True):
                o.append(v)
        cat = lambda p, t: pa.array(np.concatenate(p) if p else [], t)
        return pa.table({"query_id": cat(out[0], pa.int64()), "vec_id": cat(out[1], pa.int64()), "c": cat(out[2], pa.float64())})

    return run


def search(table: DataFrame, asks: Column, k: int, blocks: int = 16) -> DataFrame:
    """(query_id, vec_id, cosine): the k nearest of all vectors for a stated set of queries, all of them compared.

    A task gets one block of vectors and all queries, which are few by statement;
    each block keeps k of each query (and what ties with the last of them). Vectors
    without length are neither asked for nor found.
    """
    rows = table.select("vec_id", unit(F.col("embedding")).alias("v")).filter("v is not null").dropDuplicates(["vec_id"])
    x = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "vec_id", "v")
    q = rows.filter(asks).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "vec_id", "v")
    near = q.union(x).groupBy("block").applyInArrow(_best(k), "query_id long, vec_id long, c double")
    order = Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id")
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query_id", "vec_id", F.round("c", 6).alias("cosine"))
