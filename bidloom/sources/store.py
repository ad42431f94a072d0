"""Stored tables: keyed upsert, insert-ignore, file scans and the JSON sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: what a store holds after keyed overwrites."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def inserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the new ones whose key isn't there yet; of new rows with one key, any one."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def files(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, digest) of the files of one folder; the digest is of 4 KB a quarter into the file, after 512 bytes at least."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    at = F.greatest(F.lit(512), (F.col("length") / 4).cast("long"))
    return rows.select("path", "length", F.md5(F.expr("substring(content, cast(greatest(512, length / 4) as int) + 1, 4096)")).alias("digest"), at.alias("digest_at"))


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object; binary columns become base64."""
    columns = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def errors(rows: DataFrame, name: str, key: str, stage: str, checks: dict[str, Column]) -> DataFrame:
    """(source_table, key, stage, message): a row for each check (message and condition of what is wrong) that a row doesn't pass."""
    found = F.filter(F.array(*[F.when(bad, F.lit(m)) for m, bad in checks.items()]), lambda m: m.isNotNull())
    return rows.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("key"), F.lit(stage).alias("stage"), F.explode(found).alias("message"))


def write_report(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Overwrites a table; with a partition column only the partitions that the rows have."""
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
