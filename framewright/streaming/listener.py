"""What streams do, batch by batch, as rows of metrics."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

METRIC = "query string, batch long, at string, n_rows long, rows_per_second double, duration_ms long, state_rows long"


class BatchMetrics(StreamingQueryListener):
    """Keeps a row for each of the last `most` batches of all streams of a session: spark.streams.addListener(...)."""

    def __init__(self, most: int = 10_000):
        self.rows: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = sum(s.numRowsTotal for s in p.stateOperators)
        self.rows.append((p.name, p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0), int(p.durationMs.get("triggerExecution", 0)), states))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), METRIC)
