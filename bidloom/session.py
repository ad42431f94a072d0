"""Session helpers: local sessions for tests and benches, shared checkpoint folder."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, with the settings the engine is written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bidloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A session on one machine that has none gets a temporary one; on a cluster that is an error, since executors would write to their own disks."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("bidloom.own.folder", None)
    if named is None:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="bidloom-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("bidloom.own.folder", named)
    return named


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/bidloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, by: str) -> str:
    """The path of a folder with ``df`` in subfolders ``by=value``, for tasks that read parts of it themselves; what was shuffled for it is let go."""
    spark, path = df.sparkSession, _new_folder(df.sparkSession)
    df.write.partitionBy(by).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return path


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared folder and read back, which cuts its lineage and survives the loss of executors.

    Tables live under a folder of this application, which ``remove_tables`` takes away.
    """
    spark = df.sparkSession
    path = _new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Removes one table that ``materialise`` gave, and lets go of the shuffle files of what was made from it and is no longer held."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    context._jvm.System.gc()


def remove_tables(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; results that were not written before can't be read after."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/bidloom-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
