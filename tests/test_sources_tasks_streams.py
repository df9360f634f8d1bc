import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.errors import InvalidTaskState, TaskNotFound
from foliospark.operators import tasks
from foliospark.sources import content as src
from foliospark.sources import sinks
from foliospark.streaming import tasks as streams


STRUCTURED = {"pages": [{"blocks": [{"type": "paragraph_title", "content": " T ", "level": 2}, {"type": "table", "content": "x", "bbox": [1, 2], "captions": [{"content": " c "}, 5]}, {"type": "table", "content": "|a|\n|-|\n|1|"}]}]}
MIDDLE = {"pages": [{"blocks": [{}, {"type": "table", "bbox": [1, 2], "content": [{"type": "table_body", "content": " <TABLE></TABLE> "}]}]}]}


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/structured_content.json", json.dumps(STRUCTURED))
        z.writestr("a/middle_json.json", json.dumps(MIDDLE))
        z.writestr("img\\p.png", b"x")
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("x_content_list.json", json.dumps([{"type": "text", "text": "hi"}, 5]))
    df = spark.createDataFrame([("s", buffer.getvalue()), ("p", plain.getvalue())], "doc_id string, content binary")
    members = src.unzip(df)
    assert [r.path for r in members.filter("doc_id = 's'").orderBy("member_no").collect()] == ["a/structured_content.json", "a/middle_json.json", "img/p.png"]
    got = {(r.doc_id, r.item_index): r for r in src.archive_items(members).collect()}
    assert got["s", 0].text == "T" and got["s", 0].text_level == 2 and got["s", 1].table_body == "<TABLE></TABLE>" and got["s", 1].captions == ["c"] and got["s", 2].table_body.startswith("<table>")
    assert got["p", 0].text == "hi" and got["p", 1].type is None


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../../x", "C:\\x", "keep/x"])
def test_unsafe_members(name):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(name, "x")
    with pytest.raises(src.ArchiveError):
        src.archive_members(buffer.getvalue(), ("keep",))


def test_choices(spark):
    df = spark.createDataFrame([("a", "x/normalized_content_list.json"), ("a", "x/own_content_list.json"), ("b", "y/cleaned_content_list.json"), ("c", "1/normalized_content_list.json"), ("c", "2/normalized_content_list.json")], "doc_id string, path string")
    assert {r.doc_id: r.mode for r in src.checkpoint_choice(df).collect()} == {"a": "resume", "b": "full", "c": "ambiguous"}
    assert {r.doc_id: (r.path, r.error) for r in src.original_list(df).collect()} == {"a": ("x/own_content_list.json", None), "b": (None, "none"), "c": (None, "none")}


def test_uploads(spark):
    df = spark.createDataFrame([("1", "a.PDF", "application/pdf", b"%PDF-1"), ("2", "a.txt", "application/pdf", b"%PDF-1"), ("3", "a.pdf", "text/html", b"%PDF-1"), ("4", "a.pdf", "application/pdf", b"nope"), ("5", "b.pdf", "application/pdf", b"%PDF-1")], "doc_id string, filename string, content_type string, content binary")
    assert [r.error for r in src.upload_errors(df).orderBy("doc_id").collect()] == [None, "not a .pdf name", "unexpected content type", "no PDF", None]
    assert sorted(r.doc_id for r in src.distinct_uploads(df).collect()) == ["1", "4"]


def test_json_out_keeps_order_of_keys(spark, items, tmp_path):
    df = items([{"b": 1, "a": "é"}, {"type": "text"}])
    value = sinks.document_json(df).first().value
    assert value == '[\n  {\n    "b": 1,\n    "a": "é"\n  },\n  {\n    "type": "text"\n  }\n]\n'
    out = sinks.write_documents(spark.createDataFrame([("d", value)], "doc_id string, value string"), str(tmp_path / "o"), ".json").first()
    assert open(out.file, encoding="utf-8").read() == value


def base(spark):
    rows = [("b", "queued", "2026-01-01 00:00:00"), ("a", "queued", "2026-01-01 00:00:00"), ("c", "failed", "2025-01-01 00:00:00"), ("d", "running", "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id string, status string, t string")
    null = F.lit(None)
    return df.select("id", F.lit("f.pdf").alias("original_filename"), "status", F.lit(0).alias("attempt_count"), null.cast("string").alias("source_pdf_path"), null.cast("string").alias("normalized_path"), null.cast("string").alias("markdown_path"), F.lit("old").alias("error_message"), F.col("t").cast("timestamp").alias("created_at"), F.col("t").cast("timestamp").alias("updated_at"), null.cast("timestamp").alias("started_at"), null.cast("timestamp").alias("finished_at"))


def test_task_transitions(spark):
    t, NOW = base(spark), F.lit("2026-01-02 03:04:05").cast("timestamp")  # noqa: N806
    claimed, who = tasks.claim_next(t, NOW)
    got = {r.id: r for r in claimed.collect()}
    assert who == "a" and got["a"].status == "running" and got["a"].attempt_count == 1 and got["a"].error_message == "old"
    assert {r.id: r.status for r in tasks.interrupt_running(t, NOW).collect()}["d"] == "interrupted"
    assert {r.id: (r.status, r.error_message) for r in tasks.resume(t, "c", NOW).collect()}["c"] == ("queued", None)
    with pytest.raises(InvalidTaskState):
        tasks.resume(t, "a", NOW)
    with pytest.raises(TaskNotFound):
        tasks.succeed(t, "zz", "n", "m", NOW)
    assert len({r.id: r for r in tasks.fail(t, "d", "e" * 3000, NOW).collect()}["d"].error_message) == 2000
    assert tasks.completed(tasks.succeed(t, "d", "n", "m", NOW)).count() == 1
    assert tasks.create(t, "new", "x.pdf", "/x", NOW).count() == 5
    logs = spark.createDataFrame([(i, "c", "INFO", f"m{i}") for i in range(205)], "id bigint, task_id string, level string, message string").withColumn("created_at", NOW)
    recent = tasks.recent_logs(logs).orderBy("log_no").collect()
    assert [r.id for r in recent] == list(range(5, 205)) and recent[0].log_no == 1
    assert [r.id for r in tasks.logs_after(logs, "c", 200).collect()] == [201, 202, 203, 204]
    kept, left = tasks.delete(t, logs, "c")
    assert kept.count() == 3 and left.count() == 0
    assert [r.id for r in tasks.list_tasks(t, 2).collect()] == ["b", "a"]
    assert '"created_at_display":"2026-01-01 08:00:00"' in {r.id: r.json for r in tasks.task_json(t).collect()}["a"]
    more = spark.createDataFrame([(900, "a", "X" * 20, "m"), (901, "none", "I", "m")], "id bigint, task_id string, level string, message string").withColumn("created_at", NOW)
    assert [(r.id, len(r.level)) for r in tasks.append_logs(logs, more, t).filter("id >= 900").collect()] == [(900, 16)]


def test_streams_resume_without_repeats(spark, tmp_path):
    schema = "id bigint, task_id string, status string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tail = lambda: streams.tail_logs(streams.log_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "c"), str(tmp_path / "out"), 1).awaitTermination()
    write([(1, "a", "queued"), (2, "a", "running")])
    tail()
    write([(3, "b", "queued")])
    tail()
    tail()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]
    seen: list = []
    streams.snapshots(streams.log_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "c2"), seen.append).awaitTermination()
    assert {r["task_id"]: r["status"] for r in seen[-1]} == {"a": "running", "b": "queued"}
    with pytest.raises(ValueError):
        streams.after_cursor(spark.range(1), "x")
