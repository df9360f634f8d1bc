"""What changed of each task, from its events: state of one row a task, and timers for tasks that are silent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tasks import RECOVERABLE

#: The states in which a task stays silent for good.
ENDED = ("succeeded", *RECOVERABLE)
KEEPALIVE_S = 15.0
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CHANGES = "task_id string, kind string, status string, last_id bigint"


class _Changes(StatefulProcessor):
    """Gives a task's events on in order of id, but for those that leave its state as it was; keepalives while a live task sends nothing."""

    def __init__(self, keepalive_ms: int | None, every_event: bool):
        self.keepalive_ms, self.every_event = keepalive_ms, every_event

    def init(self, handle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "status string, last_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  the names that Spark calls with
        last = self.sent.get() if self.sent.exists() else None
        status, last_id = last or (None, None)
        given = False
        for event_id, new in sorted((r["id"], r["status"]) for r in rows):
            if last_id is not None and event_id <= last_id:
                continue
            if last_id is None or new != status or self.every_event:
                given = True
                yield Row(task_id=key[0], kind="change", status=new, last_id=event_id)
            status, last_id = new, event_id
        if last_id is not None and (status, last_id) != last:
            self.sent.update((status, last_id))
        if given and self.keepalive_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status not in ENDED:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keepalive_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        status, last_id = self.sent.get()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keepalive_ms)
        yield Row(task_id=key[0], kind="keepalive", status=status, last_id=last_id)

    def close(self) -> None:
        pass


def changes(events: DataFrame, keepalive_s: float | None = KEEPALIVE_S, every_event: bool = False) -> DataFrame:
    """A stream of task_id, kind, status, last_id from a stream of events(task_id, id, status, ...).

    kind is "change" where an event alters its task's status (the first one does; with every_event, all new
    ones count), and "keepalive" each time that a task which hasn't ended had no change for keepalive_s (None:
    no keepalives; they need a trigger that fires while no event comes). Events of a task are taken in order of
    id within a batch; one whose id isn't above the last is a repeat and dropped, so is one that comes late.
    State is one row a task; a batch's events of one task are sorted in memory. Null task_id: its events are
    those of one task. Null ids are dropped. Null status: a status like others.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    given = events.filter("id is not null").select("task_id", "id", "status")
    return given.groupBy("task_id").transformWithState(
        _Changes(None if keepalive_s is None else int(keepalive_s * 1000), every_event), CHANGES, "Update", "None" if keepalive_s is None else "ProcessingTime"
    )


def latest(changed: DataFrame) -> DataFrame:
    """Each task's newest status and event from a stored table of changes (keepalives left out)."""
    return changed.filter("kind = 'change'").groupBy("task_id").agg(F.max_by("status", "last_id").alias("status"), F.max("last_id").alias("last_id"))
