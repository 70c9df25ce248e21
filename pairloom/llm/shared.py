"""What the corpus operators have in common: shared storage, reading, word splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans.storage import shared_folder

__all__ = ["BROADCAST_ROWS", "cut", "shared_folder", "spread", "table", "text_batches"]

#: Rows above which a driver-built or broadcast table is not broadcast (16 bytes a row: 16 MB).
BROADCAST_ROWS = 1_000_000


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python workers at most ``rows`` rows at a time: a batch of texts is held several times over, in the JVM and in Python.

    Bytes of a batch are bounded by spark.sql.execution.arrow.maxBytesPerBatch
    (64 MB).  The setting stays with the session, as plans run after the call.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; later reads start from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out evenly where they come in fewer parts than there are cores, as a table of one file does.

    Only a table that is small beside the cluster is moved.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)
