"""Parquet table access. Every query reads whole tables through here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory: ``<directory>/<name>.parquet`` (file or folder)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
