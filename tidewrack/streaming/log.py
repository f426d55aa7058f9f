"""Progress of streams as rows, for a performance log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps one JSON line a batch; register it with spark.streams.addListener."""

    def __init__(self, keep: int = 1000):
        self.keep, self.lines = keep, []

    def onQueryStarted(self, event):
        self._add({"event": "started", "name": event.name})

    def onQueryProgress(self, event):
        p = event.progress
        self._add({"event": "progress", "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryTerminated(self, event):
        self._add({"event": "terminated", "exception": event.exception})

    def _add(self, row: dict) -> None:
        self.lines = [*self.lines[-self.keep + 1 :], json.dumps(row)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x,) for x in self.lines], "line string")
