"""Progress of streams, and counters that are taken along in a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Rows and milliseconds of each micro-batch, by query, and sums of what streams are observed for, by name; register it with spark.streams.addListener."""

    def __init__(self):
        self.batches: dict[str, list[tuple[int, int, int]]] = {}
        self.ended: dict[str, str | None] = {}
        self.observed: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.batches[str(event.id)] = []

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.setdefault(str(p.id), []).append((p.batchId, p.numInputRows, p.batchDuration))
        for name, row in p.observedMetrics.items():
            sums = self.observed.setdefault(name, {})
            for field, value in row.asDict().items():
                sums[field] = sums.get(field, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def counted(df: DataFrame, name: str, flag: str) -> tuple[DataFrame, Observation]:
    """The same rows; the observation holds ``rows`` and ``flagged`` (rows whose column ``flag`` is not null) once a job has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(flag).alias("flagged")), seen
