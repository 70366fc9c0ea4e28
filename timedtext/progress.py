"""T-d, K08: what a run has done so far, in counts that Spark gathers while it writes; nothing is read twice for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Called with what was done and its counts.
Report = Callable[[str, dict[str, int]], None]


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and what one action on it will have counted: its rows, and an aggregate for each name."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]), seen


class StreamReport(StreamingQueryListener):
    """Reports each batch of the session's streams: spark.streams.addListener(StreamReport(report)).

    batch, rows read, rows that came too late, rows of state, and what the stream observes itself.  The counts of rows read
    since the start stand in `total`, by query, also after a restart within the session.
    """

    def __init__(self, report: Report):
        self.report, self.total = report, {}

    def onQueryStarted(self, event) -> None:
        self.total.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.total[str(p.id)] = self.total.get(str(p.id), 0) + p.numInputRows
        counts = {"batch": p.batchId, "rows": p.numInputRows, "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "state": sum(s.numRowsTotal for s in p.stateOperators)}
        for seen in p.observedMetrics.values():
            counts |= seen.asDict()
        self.report(p.name or str(p.id), counts)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(str(event.id), {"ended": 1, "failed": int(event.exception is not None)})
