"""How groups are dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over three tasks a core, or the shuffle's partitions if these are more.

    Groups that run a sampler are small in bytes and long in time, so they must
    not be put together by size, as adaptive execution would; a number that is
    asked for is left alone by it.
    """
    return df.repartition(_tasks(df), *keys)


def deal_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """The same by ranges of the key, for whole replications.

    Where these are few and each takes long, a hash puts several into one task
    and leaves others empty; ranges are cut by rows, and never within a key.
    """
    return df.repartitionByRange(_tasks(df), *keys)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
