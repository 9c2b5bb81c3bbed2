"""Where results that are used again are kept: the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Uses the folder that the session names; only where none is named, as in tests, one of its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright"))


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared folder; lineage ends there."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, computed now and written as a table in the shared folder, of which later plans read only the columns they use."""
    spark = df.sparkSession
    ready(spark)
    at = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def shared(spark: SparkSession, x: object) -> Callable[[], object]:
    """Broadcasts x, whose size the caller has bounded, with the code of its class; the result gives x on an executor."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(x))
    return lambda: cloudpickle.loads(sent.value)
