"""Tasks and their logs: latest states from events, claims, transitions, pages of logs.

tasks: id, original_filename, status, attempt_count, source_pdf_path, normalized_path, markdown_path,
error_message, created_at, updated_at, started_at, finished_at. task_logs: id, task_id, level, message,
created_at. All times are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidTaskState, TaskNotFound
from ..functions.text import beijing_time, truncated
from ..session import materialise

# States, limits.
STATES = ("queued", "running", "succeeded", "failed", "interrupted")
RECOVERABLE = ("failed", "interrupted")
DELETABLE = ("failed", "interrupted", "succeeded")
LIST_LIMIT, RECENT_LOGS, PAGE_LOGS = 100, 200, 500
INTERRUPTED_MESSAGE = "the service stopped before the task ended; it can be resumed"

TASKS = (
    "id string, original_filename string, status string, attempt_count int, source_pdf_path string, normalized_path string, markdown_path string, "
    "error_message string, created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"
)
TASK_LOGS = "id bigint, task_id string, level string, message string, created_at timestamp"


def list_tasks(tasks: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest tasks, by time and id."""
    return tasks.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def latest_states(events: DataFrame, key: str = "task_id", order: str = "id", status: str = "status") -> DataFrame:
    """Each task's last status and the id of its last event, by a partial aggregate."""
    return events.groupBy(key).agg(F.max_by(status, order).alias(status), F.max(order).alias(f"last_{order}"), F.count(F.lit(1)).alias("events"))


def queue_order(tasks: DataFrame) -> DataFrame:
    """Queued tasks with claim_no: the oldest first (ties by id). For a whole queue; a claim takes only the first.

    The queue is dealt by ranges of (created_at, id) and stored; numbers within a range and the sizes of
    the ranges before it, one row a partition, give the whole order without one task for all.
    """
    queued = tasks.filter("status = 'queued'").select("id", "created_at")
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(queued.repartitionByRange(n, "created_at", "id").withColumn("part", F.spark_partition_id()), "queue")
    inside = dealt.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("created_at", "id")))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before), "part").select("id", "created_at", (F.col("no") + F.col("before")).cast("int").alias("claim_no"))


def claim_next(tasks: DataFrame, now: Column) -> tuple[DataFrame, str | None]:
    """(tasks after the claim, the claimed id): the oldest queued task runs, with one more attempt; its error and paths stay. The driver that claims is the only writer."""
    first = tasks.filter("status = 'queued'").orderBy("created_at", "id").select("id").limit(1).collect()
    if not first:
        return tasks, None
    me = F.col("id") == first[0][0]
    return _set(tasks, me, status=F.lit("running"), attempt_count=F.col("attempt_count") + 1, started_at=now, finished_at=F.lit(None).cast("timestamp"), updated_at=now), first[0][0]


def _set(tasks: DataFrame, where: Column, **values: Column) -> DataFrame:
    return tasks.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def _one(tasks: DataFrame, task_id: str, allowed: tuple[str, ...] | None = None) -> Column:
    row = tasks.filter(F.col("id") == task_id).select("status").head()
    if row is None:
        raise TaskNotFound(task_id)
    if allowed is not None and row[0] not in allowed:
        raise InvalidTaskState(row[0])
    return F.col("id") == task_id


def create(tasks: DataFrame, task_id: str, filename: str, source: str, now: Column) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    new = tasks.sparkSession.range(1).select(
        F.lit(task_id).alias("id"), F.lit(filename).alias("original_filename"), F.lit("queued").alias("status"), F.lit(0).alias("attempt_count"), F.lit(source).alias("source_pdf_path"), null("string").alias("normalized_path"), null("string").alias("markdown_path"), null("string").alias("error_message"),
        now.alias("created_at"), now.alias("updated_at"), null("timestamp").alias("started_at"), null("timestamp").alias("finished_at"),
    )
    return tasks.unionByName(new)


def interrupt_running(tasks: DataFrame, now: Column) -> DataFrame:
    """At a start of the service: what was running can be resumed."""
    return _set(tasks, F.col("status") == "running", status=F.lit("interrupted"), error_message=F.lit(INTERRUPTED_MESSAGE), finished_at=now, updated_at=now)


def resume(tasks: DataFrame, task_id: str, now: Column) -> DataFrame:
    return _set(tasks, _one(tasks, task_id, RECOVERABLE), status=F.lit("queued"), error_message=F.lit(None).cast("string"), finished_at=F.lit(None).cast("timestamp"), updated_at=now)


def succeed(tasks: DataFrame, task_id: str, normalized: str, markdown: str, now: Column) -> DataFrame:
    return _set(tasks, _one(tasks, task_id), status=F.lit("succeeded"), normalized_path=F.lit(normalized), markdown_path=F.lit(markdown), error_message=F.lit(None).cast("string"), finished_at=now, updated_at=now)


def fail(tasks: DataFrame, task_id: str, error: str, now: Column) -> DataFrame:
    return _set(tasks, _one(tasks, task_id), status=F.lit("failed"), error_message=truncated(F.lit(error), 2000), finished_at=now, updated_at=now)


def delete(tasks: DataFrame, logs: DataFrame, task_id: str, cleanup=None) -> tuple[DataFrame, DataFrame]:
    """(tasks, logs) without a finished or interrupted task and its logs; cleanup runs first, and its failure leaves both as they are."""
    me = _one(tasks, task_id, DELETABLE)
    if cleanup is not None:
        cleanup()
    return tasks.filter(~me), logs.filter(F.col("task_id") != task_id)


def completed(tasks: DataFrame) -> DataFrame:
    """Tasks that can be read: succeeded, with a Markdown file."""
    return tasks.filter("status = 'succeeded' and markdown_path is not null")


def append_logs(logs: DataFrame, new: DataFrame, tasks: DataFrame) -> DataFrame:
    """logs and new(id, task_id, level, message, created_at) of tasks that exist, level cut to 16 characters."""
    known = new.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")
    return logs.unionByName(known.withColumn("level", truncated(F.col("level"), 16)).select(logs.columns))


def logs_after(logs: DataFrame, task_id, after_id: int = 0, limit: int = PAGE_LOGS) -> DataFrame:
    """A page of a task's logs after an id, ascending; a negative id is 0."""
    return logs.filter((F.col("task_id") == task_id) & (F.col("id") > max(0, after_id))).orderBy("id").limit(limit)


def recent_logs(logs: DataFrame, limit: int = RECENT_LOGS) -> DataFrame:
    """The last logs of every task, with log_no ascending from 1."""
    last = Window.partitionBy("task_id").orderBy(F.col("id").desc())
    kept = logs.withColumn("__back", F.row_number().over(last)).filter(F.col("__back") <= limit)
    return kept.withColumn("log_no", F.max("__back").over(Window.partitionBy("task_id")) - F.col("__back") + 1).drop("__back")


def log_lines(logs: DataFrame) -> DataFrame:
    """task_id, id, line: [LEVEL] message."""
    return logs.select("task_id", "id", F.concat(F.lit("["), F.col("level"), F.lit("] "), F.col("message")).alias("line"))


def queue_summary(states: DataFrame) -> DataFrame:
    """running, queued: how many tasks are in those states."""
    return states.agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "queued").alias("queued"))


def task_json(tasks: DataFrame) -> DataFrame:
    """id, json: each task with times in UTC and, for display, in Shanghai."""
    own = [F.col(c) for c in tasks.columns]
    shown = [beijing_time(F.col(c)).alias(f"{c}_display") for c in ("created_at", "updated_at", "started_at", "finished_at") if c in tasks.columns]
    return tasks.select("id", F.to_json(F.struct(*own, *shown), {"ignoreNullFields": "false"}).alias("json"))
