"""Where intermediate tables are staged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pairloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that what reads them again doesn't work them out again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a Parquet table of their own in the shared folder and read again.

    For loops: a checkpointed DataFrame keeps the size that was guessed for its
    plan, so guesses multiply from round to round until planning itself doesn't
    end; a table that is read has the size of its files.  Tables stay.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
