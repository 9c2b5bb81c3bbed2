"""Where tables that are read again are kept: the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where it names none, as in tests, one of its own."""
    have = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if have is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright"))
        have = spark.sparkContext.getCheckpointDir()
    return have


#: Rows of a part, if keys are spread evenly.
PART_ROWS = 150_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys into parts of about so many rows (PART_ROWS): their number grows with the table, so a task's memory doesn't.

    Groups and windows by these keys (and others) need no further exchange. Rows are counted first; for a table's own columns Parquet's footers tell.
    """
    parts = -(-df.count() // (rows or PART_ROWS))
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared folder; its lineage ends there, and Spark removes it with the last reference."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
