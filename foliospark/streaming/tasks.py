"""Task snapshots and log tails as streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tasks import LIST_LIMIT, PAGE_LOGS
from ..sources.sinks import read_stage, write_stage
from .changes import KEEPALIVE_S, changes
from .log_source import PAGES_PER_BATCH, LogPages, cursor


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Appended log files as a stream. Which files were read is kept in the query's checkpoint, so a restart goes on where it stopped and each row comes once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def after_cursor(logs: DataFrame, after_id: int | str | None = None) -> DataFrame:
    """Rows after a cursor; none or a negative one is 0, text that is no integer an error."""
    return logs.filter(F.col("id") > cursor(after_id or 0))


def log_pages(spark: SparkSession, path: str, after_id: int | str | None = None, last_event_id: str | None = None, task_id: str | None = None, page_rows: int = PAGE_LOGS, pages_per_batch: int = PAGES_PER_BATCH) -> DataFrame:
    """The logs of a folder of files after a cursor as a stream whose offset is the log id, of one task or all (see log_source.LogPages)."""
    spark.dataSource.register(LogPages)
    options = {"path": path, "startingOffset": str(cursor(after_id, last_event_id)), "pageRows": str(page_rows), "pagesPerBatch": str(pages_per_batch)}
    return spark.readStream.format(LogPages.name()).options(**options, **({} if task_id is None else {"task_id": task_id})).load()


def tail_pages(pages: DataFrame, checkpoint: str, sink: str) -> StreamingQuery:
    """Writes pages to a folder as they come, until it is stopped; started again with the same checkpoint it goes on after the last id. Every batch is a folder batch=N that a repetition writes again, so each row is there once."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).start()


def drop_seen(logs: DataFrame, late: str = "1 hour", at: str = "created_at") -> DataFrame:
    """A stream of logs without ids that came before. An id is remembered until the newest time of the stream is `late` beyond its own, and rows older than that are dropped, so state doesn't grow with the stream. Null ids: the first of them only."""
    return logs.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])


def tail_logs(logs: DataFrame, checkpoint: str, sink: str, after_id: int = 0) -> StreamingQuery:
    """Writes the logs after a cursor to a folder, for all that is there now; call again for more."""
    return after_cursor(logs, after_id).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()


def latest_stream(events: DataFrame) -> DataFrame:
    """Each task's newest event and status; state is one row a task. Use with output mode update or complete."""
    return events.groupBy("task_id").agg(F.max_by("status", "id").alias("status"), F.max("id").alias("last_id"))


def snapshots(
    events: DataFrame,
    checkpoint: str,
    emit: Callable[[list[dict] | None], None],
    limit: int = LIST_LIMIT,
    available_now: bool = True,
    keepalive_s: float = KEEPALIVE_S,
) -> StreamingQuery:
    """Calls emit with the newest `limit` task states whenever they changed, and with None (a keepalive) each time that nothing was sent for keepalive_s.

    What is known of each task is state on the executors (see changes); a batch brings the driver at most
    `limit` of the tasks that changed, which it puts into the list that it sent last. The list is stored beside
    the checkpoint before it is sent, so a query that starts again goes on from it. With available_now the query
    ends with what is there, and there are no keepalives.
    """
    spark, stored = events.sparkSession, f"{checkpoint.rstrip('/')}.newest"
    known = read_stage(spark, stored)
    newest = {r["task_id"]: r.asDict() for r in known.collect()} if known is not None else {}
    sent: list = [None, time.monotonic()]  # the list that was sent last, and when anything was

    def each(batch: DataFrame, _: int) -> None:
        changed = latest_stream(batch.filter("kind = 'change' and task_id is not null").withColumnRenamed("last_id", "id"))
        for r in changed.orderBy(F.col("last_id").desc()).limit(limit).collect():
            newest[r["task_id"]] = r.asDict()
        rows = sorted(newest.values(), key=lambda r: -r["last_id"])[:limit]
        if rows != sent[0]:
            write_stage(spark.createDataFrame(rows, "task_id string, status string, last_id bigint"), stored)
            for gone in set(newest) - {r["task_id"] for r in rows}:
                del newest[gone]
            sent[:] = rows, time.monotonic()
            emit(rows)
        elif not available_now and time.monotonic() - sent[1] >= keepalive_s:
            sent[1] = time.monotonic()
            emit(None)

    given = changes(events, None if available_now else keepalive_s, every_event=True)
    writer = given.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="500 milliseconds")).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events by type in tumbling windows of event time, rows later than the watermark dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
