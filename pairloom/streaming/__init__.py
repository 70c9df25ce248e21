"""Chains that arrive as a stream of trace rows, and studies that can be ended and go on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom import study
from pairloom.sources.datasets import UNITS


def running_effects(trace: DataFrame) -> DataFrame:
    """For each sim and chain, rows so far, mean effect and acceptance; state is one row a chain.

    Use it with output mode ``update`` or ``complete``; rows may come in any order.
    """
    return trace.groupBy("sim", "chain").agg(
        F.count("*").alias("n"), F.avg("tau").alias("running_tau"), F.avg(F.col("accepted").cast("double")).alias("running_acceptance"), F.max("proposal").alias("last")
    )


def append_results(rows: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append result rows to Parquet as they come, exactly once; without ``every`` what is there is written and the query ends."""
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def finished(spark: SparkSession, folder: str) -> DataFrame | None:
    """The result rows that resumable_study has written so far; None if there are none."""
    return spark.read.option("mergeSchema", True).parquet(folder).drop("batch") if _exists(spark, f"{folder}/") else None


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def resumable_study(
    spark: SparkSession, units: str, method: str, options: study.Options, folder: str, checkpoint: str, files_a_batch: int = 1, every: str | None = None
) -> StreamingQuery:
    """A study of the replications in the files under ``units`` (see write_units), so many files at a time.

    Results are there, in ``folder``, as soon as their batch is done.  A study
    that was ended goes on where it was when it is started again with the same
    checkpoint: a batch that was under way is done again, into the same place.
    Replications that have results in other batches are left out, so it also
    goes on with a new checkpoint.  A file holds whole replications; files that
    come later are taken up, too.  Without ``every`` the query ends with the
    last file.
    """
    mark = f"{checkpoint}/study"
    if not _exists(spark, mark):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.parquet(mark)
    run = spark.read.parquet(mark).first()["run"]

    def one(batch: DataFrame, number: int) -> None:
        own = f"{run}-{number}"
        rows = batch.select("sim", "unit", "g", "x", "y")
        if _exists(batch.sparkSession, f"{folder}/"):
            known = batch.sparkSession.read.schema("sim long, batch string").parquet(folder).where(F.col("batch") != own)
            rows = rows.join(known.select("sim"), "sim", "left_anti")
        study.run_study(rows, method, options).write.mode("overwrite").parquet(f"{folder}/batch={own}")

    stream = spark.readStream.schema(UNITS).option("maxFilesPerTrigger", files_a_batch).parquet(units)
    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
