"""Stages that die, audits that contradict themselves, calls that hang, streams that idle."""

import json
import time

import pytest
from pyspark.sql import functions as F

from foliospark import session
from foliospark.errors import ContentError
from foliospark.operators import formula_audit as fa
from foliospark.operators import tasks, translate
from foliospark.plans import workflow
from foliospark.sources import sinks
from foliospark.streaming import tasks as streams


def dying(spark, rows):
    return spark.range(rows).select(F.when(F.col("id") == rows - 1, F.raise_error(F.lit("dies")).cast("bigint")).otherwise(F.col("id")).alias("id"))


def test_a_write_that_dies_leaves_the_table_before_it(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert sinks.read_stage(spark, path) is None
    with pytest.raises(Exception, match="dies"):
        sinks.write_stage(dying(spark, 9), path)
    assert sinks.read_stage(spark, path) is None
    for n in (3, 4, 5):
        sinks.write_stage(spark.range(n), path)
        with pytest.raises(Exception, match="dies"):
            sinks.write_stage(dying(spark, 9), path)
        assert sinks.read_stage(spark, path).count() == n
    sinks.write_stage(sinks.read_stage(spark, path).filter("id > 0"), path)  # reads what it replaces
    assert sinks.read_stage(spark, path).count() == 4


def test_compacted_outcomes_keep_the_newest(spark, tmp_path):
    rows = [("d", "text", 0, "", 0, "failed", 1), ("d", "text", 0, "", 0, "success", 2), ("d", "text", 1, "", 0, "failed", 1)]
    df = spark.createDataFrame(rows, "doc_id string, kind string, item_index bigint, field string, pos int, status string, written_at int")
    sinks.compact_outcomes(df, str(tmp_path / "o"))
    assert sorted((r.item_index, r.status) for r in sinks.read_stage(spark, str(tmp_path / "o")).collect()) == [(0, "success"), (1, "failed")]


def test_log_sink_writes_to_the_other_target_when_one_fails(spark, tmp_path):
    batch = spark.createDataFrame([("foliospark.web.x", "a"), ("other", "b"), (None, "c")], "logger string, message string")
    write = sinks.log_sink(str(tmp_path / "logs"), "no_such_database.logs")
    with pytest.raises(Exception, match="no_such_database"):
        write(batch, 0)
    assert sorted(r.message for r in spark.read.parquet(str(tmp_path / "logs")).collect()) == ["b", "c"]


class Rejecting:
    """A validator that knows some formulas as invalid."""

    def __init__(self, *bad):
        self.bad = bad

    def __call__(self, formulas):
        return ["bad" if f in self.bad else None for f, _ in formulas]


def records_of(spark, items, *bad):
    given = [{"type": "text", "text": "a $F I C 1$ b $x$ c $F I C 2$", "page_idx": 3, "bbox": [1, 2, 3]}, {"type": "text", "text": "$y$ and $F I C 1$", "page_idx": 4, "bbox": {"b": 1.5, "a": "é"}}, {"type": "equation", "text": "$$F I C 3$$", "page_idx": 4}]
    made = items(given)
    return made, fa.audit(fa.scan_items(made), Rejecting(*bad))


def test_rejected_and_invalid_formulas(spark, items):
    _, records = records_of(spark, items, "x", r"\mathrm{FIC2}")
    got = {r.katex_formula: (r.syntax_status, r.normalization_status, r.raw_validation_error, r.validation_error) for r in records.collect()}
    assert got == {"F I C 1": ("valid", "accepted", None, None), "x": ("invalid_syntax", "not_applicable", "bad", None), "F I C 2": ("valid", "rejected", None, "bad"), "y": ("valid", "not_applicable", None, None), "F I C 3": ("valid", "accepted", None, None)}
    s = fa.summary(records).first()
    assert (s.total_formulas, s.valid_count, s.invalid_syntax_count, s.normalization_accepted_count, s.normalization_rejected_count) == (6, 5, 1, 3, 1)
    assert s.invalid_syntax_page_indices == [3] and s.problem_page_indices == [3, 4]


def test_ids_are_hashes_of_place_and_content_in_one_form(spark, items):
    import hashlib

    _, records = records_of(spark, items)
    boxes = {0: [1, 2, 3], 1: {"b": 1.5, "a": "é"}, 2: None}
    for r in records.collect():
        place = {"page_idx": r.page_idx, "bbox": boxes[r.item_index], "source_type": r.source_type, "field_path": r.field_path, "table_row_idx": None, "table_col_idx": None, "formula_index": r.formula_index, "content_hash": r.content_hash}
        want = hashlib.sha256(json.dumps(place, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]
        assert r.formula_id == f"formula_{want}"


def test_repairs_by_place_are_those_by_content(spark, items):
    from foliospark.functions.formulas import replace_equation, replace_spans

    made, records = records_of(spark, items, r"\mathrm{FIC2}")
    placed = {r.item_index: r.text for r in fa.replace_in_items(made, records).collect()}
    lists = fa.replacement_lists(fa.accepted_replacements(records))
    text = F.when(F.col("type") == "equation", replace_equation(F.col("text"), F.col("replacements"))).otherwise(replace_spans(F.col("text"), F.col("replacements")))
    assert placed == {r.item_index: r.t for r in made.join(lists, "doc_id").select("item_index", text.alias("t")).collect()}
    assert placed == {0: r"a $\mathrm{FIC1}$ b $x$ c $F I C 2$", 1: r"$y$ and $\mathrm{FIC1}$", 2: r"$$\mathrm{FIC3}$$"}


def test_hot_formulas_are_joined_alike(spark, items, monkeypatch):
    made = items([{"type": "text", "text": f"$x$ and $F I C {i % 3}$"} for i in range(40)])
    want = None
    for hot in (1, 1000):
        monkeypatch.setattr(session, "HOT_KEYS", hot)
        got = sorted((r.item_index, r.formula_index, r.normalized_formula or "") for r in fa.audit(fa.scan_items(made)).collect())
        want = want or got
        assert len(got) == 80 and got == want


@pytest.mark.parametrize(
    "change,error",
    [
        ({"syntax_status": "'odd'"}, "unknown syntax status"), ({"suspicious": "not suspicious"}, "suspicious does not match its rules"), ({"statuses": "array('valid')"}, "statuses do not match"), ({"raw_validation_error": "'e'"}, "an error with a valid formula"),
        ({"normalization_status": "'odd'"}, "unknown normalization status"), ({"normalized_formula": "null"}, "a repair without text or rule"), ({"normalized_formula": "raw_formula"}, "a repair that changes nothing"), ({"validation_error": "'e'"}, "an error with an accepted repair"),
        ({"normalization_status": "'rejected'"}, "no error with a rejected repair"), ({"normalization_rules": "array('a', 'a')"}, "a rule is named twice"), ({"content_hash": "repeat('0', 64)"}, "wrong content hash"), ({"formula_id": "'x'"}, "no formula_id"),
        ({"source_type": "'table_cell'"}, "a table cell without its place"), ({"cell_tag": "'td'"}, "a place in a table without a table"), ({"field_path": "'x'"}, "an incomplete place"), ({"normalization_rules": "array('')"}, "a rule without a name"),
    ],
)
def test_damaged_records(spark, items, change, error):
    made = items([{"type": "text", "text": "$F I C 1$"}])
    records = fa.audit(fa.scan_items(made))
    assert fa.record_errors(records).count() == 0
    bad = records.withColumns({k: F.expr(v).cast(records.schema[k].dataType) for k, v in change.items()})
    assert [r.error for r in fa.record_errors(bad).collect()] == [error]
    assert {r.error for r in fa.record_errors(records.union(records)).collect()} == {"formula_id given twice"}


def legacy(records):
    return records.withColumn("validation_error", F.col("raw_validation_error")).withColumns({"normalized_formula": F.lit(None).cast("string"), "normalization_rule": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}).select(fa.LEGACY_COLUMNS)


def test_versions_of_reports(spark, items, tmp_path):
    made = items([{"type": "text", "text": "$F I C 1$"}])
    records = fa.audit(fa.scan_items(made))
    assert records.columns == fa.RECORD_COLUMNS and fa.report_version(records.columns) == 2 and fa.report_version(fa.LEGACY_COLUMNS) == 1
    for odd in (records.columns[1:], [*records.columns, "more"], ["a"]):
        with pytest.raises(ContentError):
            fa.report_version(odd)
    old = legacy(records)
    assert fa.legacy_record_errors(old).count() == 0
    assert [r.error for r in fa.legacy_record_errors(old.withColumn("confidence", F.lit(0.5))).collect()] == ["a repair in a version without repairs"]
    out, services = str(tmp_path / "o"), workflow.Services()
    sinks.write_stage(old, f"{out}/formula_audit")
    assert workflow.ensure_audit(made, out, services).columns == fa.RECORD_COLUMNS  # rebuilt
    sinks.write_stage(records.withColumn("syntax_status", F.lit("odd")), f"{out}/formula_audit")
    with pytest.raises(ContentError, match="contradicts"):
        workflow.ensure_audit(made, out, services)
    sinks.write_stage(old.withColumn("validation_error", F.lit("e")), f"{out}/formula_audit")
    with pytest.raises(ContentError, match="contradicts"):
        workflow.ensure_audit(made, out, services)


def test_unreadable_audits_are_not_written_over(spark, items, tmp_path):
    made, out = items([{"type": "text", "text": "$x$"}]), tmp_path / "o"
    sinks.write_stage(fa.audit(fa.scan_items(made)), f"{out}/formula_audit")
    for f in (out / "formula_audit" / "v00000001").glob("*part*"):
        f.unlink()
        f.write_bytes(b"damaged")
    with pytest.raises(Exception, match="."):
        workflow.ensure_audit(made, str(out), workflow.Services()).count()
    assert [p.name for p in (out / "formula_audit").iterdir()] == ["v00000001"]


def test_an_audit_never_overwrites_its_source(spark, items, tmp_path):
    made = items([{"type": "text", "text": "$x$"}])
    for target in (tmp_path / "a", tmp_path / "a" / "b", tmp_path):
        with pytest.raises(ContentError, match="overwrite"):
            workflow.write_audit(made, str(tmp_path / "a"), str(target), workflow.Services())


class Slow(translate.UppercaseTranslator):
    def translate(self, text, *, strict=False, response_format=None):
        if "slow" in text:
            time.sleep(6)
        return super().translate(text, strict=strict, response_format=response_format)


def test_a_hanging_call_fails_alone(spark):
    rows = [("d", "text", i, "", 0, "slow" if i == 0 else f"text {i}", False) for i in range(6)]
    units = spark.createDataFrame(rows, "doc_id string, kind string, item_index bigint, field string, pos int, text string, is_empty boolean").coalesce(1)
    began = time.monotonic()
    got = {r.item_index: (r.status, r.translated, r.error) for r in translate.run_units(units, Slow(), 0, 2, timeout_s=1.0).collect()}
    assert got[0] == ("failed", None, "no answer within 1 s") and all(got[i] == ("success", f"TEXT {i}", None) for i in range(1, 6))
    assert time.monotonic() - began < 30
    got = translate.run_units(units.filter("item_index > 0"), Slow(), 0, 3).collect()
    assert sorted(r.translated for r in got) == [f"TEXT {i}" for i in range(1, 6)]


def test_queue_order_over_ranges(spark):
    rows = [(str(i), "queued" if i % 7 else "failed", f"2026-01-{1 + i % 5:02d} 00:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, status string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    want = sorted((t, i) for i, s, t in rows if s == "queued")
    got = {r.claim_no: r.id for r in tasks.queue_order(df).collect()}
    assert [got[n + 1] for n in range(len(want))] == [i for _, i in want] and len(got) == len(want)
    assert tasks.queue_order(df.limit(0)).count() == 0


def test_an_idle_stream_sends_keepalives_and_no_empty_list(spark, tmp_path):
    schema = "id bigint, task_id string, status string"
    spark.createDataFrame([(1, "a", "queued")], schema).write.parquet(str(tmp_path / "in"))
    seen: list = []
    query = streams.snapshots(streams.log_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "c"), seen.append, available_now=False, keepalive_s=0.5)
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and seen.count(None) < 2:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen.count(None) >= 2 and [x for x in seen if x] == [[{"task_id": "a", "status": "queued", "last_id": 1}]]
    assert all(x is None or x == [] or x[0]["task_id"] == "a" for x in seen)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": staticmethod(Conf), "master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Spark())


def test_diagnostics_name_the_placeholders(spark):
    class Doubles(translate.UppercaseTranslator):
        def translate(self, text, *, strict=False, response_format=None):
            return text if strict else text + text

    got = translate.translate_text("see $x$ here", "0" * 16, Doubles(), 1)
    assert got["status"] == "success" and [d["phase"] for d in got["diagnostics"]] == ["normal"]
    d = got["diagnostics"][0]
    assert d["error"] == "a placeholder is repeated" and d["duplicate"] == d["expected"] and len(d["actual"]) == 2 and d["missing"] == d["unknown"] == d["tampered"] == []


def test_math_settings_name_the_delimiters_that_are_scanned():
    from foliospark.functions.formulas import scan_spans
    from foliospark.functions.markdown import MATH_SETTINGS

    for d in MATH_SETTINGS["delimiters"]:
        raw = f"{d['left']}x{d['right']}"
        assert [(s[0], s[2]) for s in scan_spans(f"a {raw} b")] == [(raw, d["display"])]
