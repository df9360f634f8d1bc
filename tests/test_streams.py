"""Log pages by id, repeated ids, changes of tasks: across restarts, and against plain Python."""

import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.streaming import changes, log_source
from foliospark.streaming import tasks as streams

LOGS = "id bigint, task_id string, level string, message string, created_at timestamp"
EVENTS = "task_id string, id bigint, status string"


@pytest.mark.parametrize("given,want", [((None, None), 0), ((5, None), 5), (("5", "7"), 7), ((5, "-3"), 0), ((5, " 12 "), 12), ((-1, None), 0), ((5, "0"), 0)])
def test_cursors(given, want):
    assert log_source.cursor(*given) == want


@pytest.mark.parametrize("text", ["x", "1.5", ""])
def test_cursors_that_are_no_integers(text):
    with pytest.raises(ValueError):
        log_source.cursor(3, text)


def add_logs(spark, path, ids, task="a", files=1):
    rows = spark.createDataFrame([(i, task, "INFO", f"m{i}") for i in ids], "id bigint, task_id string, level string, message string")
    rows.withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp")).repartition(files).write.mode("append").parquet(path)


def drain(pages, base):
    query = streams.tail_pages(pages, f"{base}/checkpoint", f"{base}/rows")
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_pages_after_a_cursor_and_a_restart(spark, tmp_path):
    base, logs = str(tmp_path), str(tmp_path / "logs")
    add_logs(spark, logs, range(1, 120), files=3)
    add_logs(spark, logs, [500, 900], "b")
    pages = lambda: streams.log_pages(spark, logs, last_event_id="10", page_rows=7, pages_per_batch=3)
    drain(pages(), base)
    add_logs(spark, logs, [901, 903, 950], files=2)
    drain(pages(), base)
    drain(pages(), base)
    got = spark.read.parquet(f"{base}/rows")
    assert sorted(r.id for r in got.collect()) == [*range(11, 120), 500, 900, 901, 903, 950]
    sizes = Counter(r.batch for r in got.collect())
    assert max(sizes.values()) <= 21 and len(sizes) >= 6


def test_pages_of_one_task(spark, tmp_path):
    add_logs(spark, str(tmp_path / "logs"), range(1, 30, 2), "a")
    add_logs(spark, str(tmp_path / "logs"), range(2, 30, 2), "b")
    drain(streams.log_pages(spark, str(tmp_path / "logs"), after_id=5, task_id="b", page_rows=4, pages_per_batch=1), str(tmp_path))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == list(range(6, 30, 2))


def test_a_killed_query_reads_its_batch_again(spark, tmp_path):
    """The first writer of a batch dies after it wrote, so the batch isn't committed; new logs come; the same ids are read again."""
    base, logs = str(tmp_path), str(tmp_path / "logs")
    add_logs(spark, logs, range(1, 51), files=2)
    pages = lambda: streams.log_pages(spark, logs, page_rows=5, pages_per_batch=2)
    calls = []

    def dies(batch, n):
        calls.append((n, sorted(r.id for r in batch.collect())))
        if n == 1:
            raise RuntimeError("killed")

    query = pages().writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(dies).start()
    with pytest.raises(Exception, match="killed"):
        query.processAllAvailable()
    query.stop()
    add_logs(spark, logs, range(51, 61))
    drain(pages(), base)
    assert calls == [(0, list(range(1, 11))), (1, list(range(11, 21)))]
    again = defaultdict(list)
    for r in spark.read.parquet(f"{base}/rows").collect():
        again[r.batch].append(r.id)
    assert sorted(again[1]) == list(range(11, 21)) and 0 not in again
    assert sorted(i for ids in again.values() for i in ids) == list(range(11, 61))


def test_the_reader_by_itself(spark, tmp_path):
    """Row groups in any order, ids that repeat, an empty folder, files without rows."""
    logs = str(tmp_path / "logs")
    add_logs(spark, logs, [9, 3, 7, 3, 3, 1], files=3)
    add_logs(spark, logs, [])
    reader = log_source.LogPageReader({"path": logs, "pageRows": "2", "pagesPerBatch": "1"})
    assert reader.initialOffset() == {"id": 0} and reader.latestOffset() == {"id": 3}
    parts = reader.partitions({"id": 0}, {"id": 9})
    assert [(p.low, p.high) for p in parts] == [(0, 3), (3, 9)]
    assert [b.column(0).to_pylist() for p in parts for b in reader.read(p)] == [[1, 3, 3, 3], [7, 9]]
    assert reader.latestOffset() == {"id": 9} and reader.latestOffset() == {"id": 9} and reader.partitions({"id": 9}, {"id": 9}) == []
    (tmp_path / "none").mkdir()
    assert log_source.LogPageReader({"path": str(tmp_path / "none")}).latestOffset() == {"id": 0}
    with pytest.raises(ValueError):
        log_source.LogPageReader({"path": logs, "pageRows": "0"})


def test_old_files_are_not_opened_again(spark, tmp_path, monkeypatch):
    logs = str(tmp_path / "logs")
    add_logs(spark, logs, range(1, 10))
    reader = log_source.LogPageReader({"path": logs})
    assert reader.latestOffset() == {"id": 9} and list(reader.tops.values()) == [9]
    reader.latestOffset()
    opened = []
    real = log_source.ds.ParquetFileFragment.split_by_row_group
    add_logs(spark, logs, [12])
    monkeypatch.setattr(log_source.LogPageReader, "_groups_of", staticmethod(lambda f: opened.append(f.path) or real(f)))
    assert reader.latestOffset() == {"id": 12} and len(opened) == 1


def test_seen_ids_are_dropped_and_forgotten(spark, tmp_path):
    path, rows = str(tmp_path / "in"), str(tmp_path / "rows")

    def add(*pairs):
        df = spark.createDataFrame([(i, t) for i, t in pairs], "id bigint, t string").select("id", F.col("t").cast("timestamp").alias("created_at"))
        df.coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = streams.log_stream(spark, path, "id bigint, created_at timestamp", 1)
        writer = streams.drop_seen(stream, "1 hour").writeStream.format("parquet").option("path", rows).option("checkpointLocation", str(tmp_path / "c"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]

    add((1, "2026-01-01 00:00"), (2, "2026-01-01 00:01"), (2, "2026-01-01 00:02"))
    run()
    add((2, "2026-01-01 00:01"), (3, "2026-01-01 00:30"))
    run()
    add((4, "2026-01-01 09:00"))
    kept = run()
    add((4, "2026-01-01 09:01"), (5, "2026-01-01 01:00"))
    kept += run()
    assert sorted(r.id for r in spark.read.parquet(rows).collect()) == [1, 2, 3, 4]  # 5 is later than the watermark
    assert kept[-1] <= 2


def plain_changes(batches, every=False):
    last, out = {}, []
    for batch in batches:
        for task, i, status in sorted((r for r in batch if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
            if task in last and i <= last[task][1]:
                continue
            if task not in last or last[task][0] != status or every:
                out.append((task, "change", status, i))
            last[task] = status, i
    return sorted(out, key=str)


@pytest.mark.parametrize("every", [False, True])
def test_changes_across_restarts(spark, tmp_path, every):
    batches = [
        [("a", 1, "queued"), ("a", 3, "running"), ("a", 2, "queued"), ("b", 4, "queued"), (None, 5, "x"), ("c", None, "x")],
        [("a", 3, "failed"), ("a", 6, "running"), ("b", 7, None), ("b", 8, None), (None, 9, "x")],
        [("a", 10, "succeeded"), ("b", 2, "queued"), ("b", 11, "queued"), ("d", 12, "queued")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.log_stream(spark, str(tmp_path / "in"), EVENTS)
        writer = changes.changes(stream, None, every).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        writer.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"rows/batch={n}"))).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    got = sorted(((r.task_id, r.kind, r.status, r.last_id) for r in rows.collect()), key=str)
    assert got == plain_changes(batches, every)
    newest = {r.task_id: (r.status, r.last_id) for r in changes.latest(rows).collect()}
    assert newest["a"] == ("succeeded", 10) and newest["d"] == ("queued", 12)


def test_keepalives_by_timer_until_a_task_ends(spark, tmp_path):
    put = lambda *rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(("a", 1, "running"), ("b", 2, "succeeded"))
    query = changes.changes(streams.log_stream(spark, str(tmp_path / "in"), EVENTS), 0.5).writeStream.outputMode("update").format("memory").queryName("kept_alive")
    query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def wait(done):
        until = time.monotonic() + 90
        while time.monotonic() < until and not done([tuple(r) for r in spark.table("kept_alive").collect()]):
            time.sleep(0.2)
        return [tuple(r) for r in spark.table("kept_alive").collect()]

    try:
        rows = wait(lambda rows: rows.count(("a", "keepalive", "running", 1)) >= 2)
        assert rows.count(("a", "change", "running", 1)) == 1 and rows.count(("a", "keepalive", "running", 1)) >= 2
        put(("a", 3, "failed"))
        wait(lambda rows: ("a", "change", "failed", 3) in rows)
        n = len(spark.table("kept_alive").collect())
        time.sleep(2.5)
        rows = [tuple(r) for r in spark.table("kept_alive").collect()]
        assert len(rows) == n and all(r[0] != "b" or r[1] == "change" for r in rows)
    finally:
        query.stop()


def test_snapshots_go_on_from_the_list_they_sent(spark, tmp_path):
    sent: list = []
    run = lambda: streams.snapshots(streams.log_stream(spark, str(tmp_path / "in"), EVENTS), str(tmp_path / "c"), sent.append, limit=2).awaitTermination()
    for batch in ([("a", 1, "queued"), ("b", 2, "queued"), ("c", 3, "queued")], [("a", 4, "running")], []):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert [[(r["task_id"], r["last_id"]) for r in rows] for rows in (sent[0], sent[-1])] == [[("c", 3), ("b", 2)], [("a", 4), ("c", 3)]]


def test_neighbouring_pages_share_a_partition(spark, tmp_path, monkeypatch):
    """A row group isn't decoded once for each of its pages, nor are ids read twice or row groups listed again for each batch."""
    logs = str(tmp_path / "logs")
    add_logs(spark, logs, range(1, 101), files=1)
    listed, real = [], log_source.ds.ParquetFileFragment.split_by_row_group
    monkeypatch.setattr(log_source.LogPageReader, "_groups_of", staticmethod(lambda f: listed.append(f.path) or real(f)))
    reader = log_source.LogPageReader({"path": logs, "pageRows": "2", "pagesPerBatch": "20"})
    for low, high in ((0, 40), (40, 80), (80, 100)):
        assert reader.latestOffset() == {"id": high}
        parts = reader.partitions({"id": low}, {"id": high})
        assert len(parts) <= 4
        assert [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()] == list(range(low + 1, high + 1))
    assert len(listed) == 1
    assert log_source.LogPageReader({"path": logs, "pageRows": "2", "pagesPerBatch": "20"}).partitions({"id": 40}, {"id": 80})[-1].high == 80
