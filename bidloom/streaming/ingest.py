"""Incremental ingest: new documents are sketched, and paired with stored and new ones, batch by batch.

Sketches live in a table of bands, not in a stream's state, partitioned by band
number; a batch joins each band with the stored rows of it. A batch is written
under its number, so one that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators import sketch
from bidloom.session import materialise


def sketches(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, sig) of arriving paragraphs with their tokens."""
    rows = paragraphs.dropDuplicates(["para_id"]).select("doc_id", F.explode("tokens").alias("t")).select("doc_id", F.lower("t").alias("token"))
    return sketch.minhash(rows.filter(F.length("token") > 1), "doc_id")


#: Slots of a band: with 32 slots, 16 bands of 2 let a pair of similarity 0.5 meet with probability 0.99, one of 0.4 with 0.94.
ROWS = 2


def bands(sigs: DataFrame) -> DataFrame:
    """(doc_id, sig, band, x): a row for each band of each signature."""
    return sigs.select("doc_id", "sig", F.posexplode(F.array(*[F.xxhash64(F.slice("sig", ROWS * i + 1, ROWS)) for i in range(32 // ROWS)])).alias("band", "x"))


def pairs(new: DataFrame, old: DataFrame | None, least: float = 0.5) -> DataFrame:
    """(doc_a, doc_b, estimate): new documents with stored and new ones, by bands and then by all slots; ``old`` are stored bands."""
    own = bands(new)
    every = own if old is None else own.unionByName(old.join(new.select("doc_id"), "doc_id", "left_anti").select(*own.columns))
    a = own.select(F.col("doc_id").alias("n"), F.col("sig").alias("s"), "band", "x")
    rows = a.join(every, ["band", "x"]).filter("n <> doc_id")
    rows = rows.select(F.least("n", "doc_id").alias("doc_a"), F.greatest("n", "doc_id").alias("doc_b"), (sketch.equal_slots(F.col("s"), F.col("sig")) / 32).alias("estimate"))
    return rows.filter(F.col("estimate") >= least).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at the path; anything else that goes wrong is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def start(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, least: float = 0.5):
    """A stream over Parquet files of paragraphs; ``store`` gets the tables bands and pairs. A document arrives whole, in one file."""

    def write(batch: DataFrame, number: int) -> None:
        new, old = materialise(sketches(batch)), None
        if exists(spark, f"{store}/bands"):
            old = spark.read.parquet(f"{store}/bands").filter(F.col("batch") < number).drop("batch")
        pairs(new, old, least).write.mode("overwrite").parquet(f"{store}/pairs/batch={number}")
        bands(new).write.mode("overwrite").partitionBy("band").parquet(f"{store}/bands/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
