"""Counters of running stages, taken on the way: no second pass over what a stage writes."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def _counts(conditions: dict[str, Column | None]) -> list[Column]:
    return [(F.count(F.lit(1)) if c is None else F.count_if(F.coalesce(c, F.lit(False)))).alias(name) for name, c in conditions.items()]


def run_counted(rows: DataFrame, action: Callable[[DataFrame], None], **conditions: Column | None) -> dict[str, int]:
    """Run action (one that reads rows once, a write say) and count on the way the rows that meet each condition; None counts all.
    A null condition is not met. Rows that tasks repeat after a loss count once."""
    seen = Observation()
    action(rows.observe(seen, *_counts(conditions)))
    return dict(seen.get)


def counted_stream(rows: DataFrame, name: str, **conditions: Column | None) -> DataFrame:
    """A stream whose progress carries the counters of each batch under name; StageCounters adds them up."""
    return rows.observe(name, *_counts(conditions))


class StageCounters(StreamingQueryListener):
    """Sums by stage of all batches of the session's streams. A batch that is run again after a failure reports once, when it ends."""

    def __init__(self):
        self._lock, self.totals, self._seen = threading.Lock(), {}, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            if (p.id, p.batchId) in self._seen or not p.numInputRows:
                return
            self._seen.add((p.id, p.batchId))
            for stage, row in p.observedMetrics.items():
                self.totals.setdefault(stage, Counter()).update(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
