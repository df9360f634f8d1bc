import json

from foliospark.functions.markdown import safe_markdown, table_to_html
from foliospark.operators import formula_audit, render, translate
from foliospark.operators.translate import UppercaseTranslator, translate_table, translate_text

NONCE = "0" * 16


class Scripted:
    """Answers in turn; an exception is raised, a function is called."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def translate(self, text, *, strict=False, response_format=None):
        self.asked.append((text, strict))
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(answer, Exception):
            raise answer
        return answer(text) if callable(answer) else answer


def test_text_retries():
    t = Scripted(ValueError("down"), lambda x: x.upper() if "⟪" not in x else x)
    assert translate_text("abc", NONCE, t, 1) | {"x": 1} == {"status": "success", "translated": "ABC", "error": None, "model_calls": 2, "level": "full_retry", "success_cells": None, "fallbacks": None, "diagnostics": None, "x": 1}
    assert translate_text("abc", NONCE, Scripted(" "), 2)["error"] == "an empty translation"
    assert translate_text(None, NONCE, t, 1)["model_calls"] == 0


def test_placeholder_error_asks_strictly_then_splits():
    t = Scripted("lost", "lost", lambda x: x.replace("First", "Erst"), "lost again")
    got = translate_text("First $x$. Then $y$.", NONCE, t, 1)
    assert got["status"] == "success" and got["translated"] == "Erst $x$. Then $y$." and got["model_calls"] == 4 and got["level"] == "split_retry"
    assert [s for _, s in t.asked] == [False, True, True, True]
    assert translate_text("First $x$. Then $y$.", NONCE, Scripted("lost"), 0)["error"] == "every chunk failed"
    assert "no sentences" in translate_text("One $x$", NONCE, Scripted("lost"), 0)["error"]


def cells(**texts):
    return json.dumps({"cells": [{"cell_id": k.replace("_", "-"), "translated_text": v} for k, v in texts.items()]})


def test_table_rounds_and_partial_success():
    html = "<table><tr><td>one</td><td>two</td></tr></table>"
    got = translate_table(html, False, Scripted(cells(cell_0001="eins"), cells(cell_0002="$")), 1)
    assert got["status"] == "success" and got["translated"] == "<table><tr><td>eins</td><td>two</td></tr></table>" and got["model_calls"] == 2
    assert got["fallbacks"] == [{"cell_id": "cell-0002", "error": "there is a new formula sign"}]
    assert translate_table(html, False, Scripted("no json"), 0)["fallbacks"][0]["error"] == "the answer is no JSON"
    assert translate_table("", True, Scripted(""), 1)["status"] == "skipped"
    assert translate_table("<p>", False, Scripted(""), 1)["status"] == "failed"
    assert translate_table("<table><tr><td>12</td></tr></table>", False, Scripted(""), 1)["model_calls"] == 0


def test_answers():
    fine, errors, warnings = translate.parse_answer(["a", "b", "c", "d"], json.dumps({"cells": [{"cell_id": "a", "translated_text": "x"}, {"cell_id": "b", "translated_text": "x"}, {"cell_id": "b", "translated_text": "y"}, {"cell_id": "c", "translated_text": "x", "more": 1}, {"cell_id": "z"}, 5]}))
    assert fine == {"a": "x"} and set(errors) == {"b", "c", "d"} and len(warnings) == 2


def test_plan_limits():
    item = lambda n, tokens: (f"c{n}", "a" * 4 * (tokens - 13), 0)
    assert [len(b) for b in translate.plan([item(i, 20) for i in range(13)], 12)] == [12, 1]
    assert [len(b) for b in translate.plan([item(0, 1500), item(1, 600)], 12)] == [1, 1]
    assert [len(b) for b in translate.plan([("a", "x", 20), ("b", "x", 5)], 12)] == [1, 1]
    assert [len(b) for b in translate.plan([item(0, 5000), item(1, 20)], 12)] == [1, 1]


def given(items):
    return items(
        [
            {"type": "text", "text": "Intro $x$ ok", "text_level": 1, "page_idx": 0}, {"type": "text", "text": 5}, {"type": "table", "table_body": "<table><tr><td>cell</td></tr></table>", "table_caption": ["cap", " ", 3]},
            {"type": "table", "table_caption": [[" "], None]}, {"type": "image", "img_path": "a.png", "image_caption": ["photo"], "image_footnote": []}, {"type": "equation", "text": " e = 1 "}, {"type": "ref_text", "text": "[1] $x$"}, {"type": "header", "text": "h"},
        ]
    )


def test_states_run_stats_resume(spark, items, tmp_path):
    df = given(items)
    states, aux = translate.new_states(df), translate.auxiliary_units(df)
    assert sorted((r.field, r.pos, r.status) for r in aux.collect()) == [("image_caption", 0, "pending"), ("table_caption", 0, "failed"), ("table_caption", 0, "pending"), ("table_caption", 1, "failed"), ("table_caption", 1, "failed"), ("table_caption", 2, "failed")]
    units = translate.work_units(states, aux)
    assert units.count() == 6
    translate.run_units(units, UppercaseTranslator(), concurrency=2).write.parquet(str(tmp_path / "out"))
    outcomes = spark.read.parquet(str(tmp_path / "out"))
    done = translate.apply_outcomes(states, outcomes)
    got = {r.item_index: r for r in done.collect()}
    assert got[0].translated_text == "INTRO $x$ OK" and got[1].translation_status == "failed" and got[3].translation_status == "skipped" and got[2].translated_table_body.count("CELL") == 1
    assert translate.left_pending(done).count() == 0
    s = translate.translation_stats(done, outcomes, aux).first()
    assert (s.text_count, s.success_count, s.failed_count, s.table_success_count, s.table_skipped_count, s.auxiliary_count) == (2, 1, 1, 1, 1, 6)
    assert translate.resume_errors(df, done).count() == 0
    again = translate.resume_states(df, done)
    assert [r.item_index for r in translate.work_units(again).collect()] == [1]
    assert translate.resume_errors(df.filter("item_index < 7"), done).collect()[0].error == "the number of items differs"


def test_render(items):
    df = given(items)
    assert render.render(df).first().markdown == "# Intro $x$ ok\n\ncap\n\n<table><tr><td>cell</td></tr></table>\n\n![](a.png)\n\nphoto\n\n$$\ne = 1\n$$\n\n[1] $x$\n"
    assert render.render(items([{"type": "novel"}])).first().markdown == ""


def test_render_with_repairs_and_translations(spark, items):
    df = translate.new_states(given(items))
    fixed = spark.createDataFrame([("d", [("$x$", False, "$y$")])], "doc_id string, replacements array<struct<raw_formula:string,is_block:boolean,normalized:string>>")
    aux = spark.createDataFrame([("d", 4, "image_caption", 0, "FOTO $x$")], "doc_id string, item_index bigint, field string, pos int, translated string")
    got = render.render(df, fixed, aux).first().markdown
    assert "# Intro $y$ ok" in got and "FOTO $y$" in got and "[1] $x$" in got


def test_audit_with_a_scripted_validator(spark, items):
    df = items([{"type": "text", "text": r"a $\neqq$ b $F I C 1$", "page_idx": 2}, {"type": "equation", "text": r"\frac{m 3}{h}", "page_idx": 1}, {"type": "table", "table_body": "<table><tr><td>$bad$</td></tr></table>"}])
    rejects = lambda pairs: [f"no {f}" if "bad" in f or "mathrm{m}" in f else None for f, _ in pairs]
    rows = formula_audit.audit(formula_audit.scan_items(df), rejects)
    got = {r.raw_formula: (r.syntax_status, r.suspicious, r.normalization_status) for r in rows.collect()}
    assert got == {r"$\neqq$": ("valid", True, "not_applicable"), "$F I C 1$": ("valid", True, "accepted"), r"\frac{m 3}{h}": ("valid", True, "rejected"), "$bad$": ("invalid_syntax", False, "not_applicable")}
    s = formula_audit.summary(rows).first()
    assert (s.total_formulas, s.issue_formula_count, s.normalization_accepted_count, s.normalization_rejected_count) == (4, 4, 1, 1)
    assert s.problem_page_indices == [1, 2] and s.invalid_syntax_page_indices == []
    assert formula_audit.record_errors(rows).count() == 0 and formula_audit.report_errors(rows, formula_audit.summary(rows)).count() == 0
    assert [(r.raw_formula, r.normalized) for r in formula_audit.accepted_replacements(rows).collect()] == [("$F I C 1$", r"$\mathrm{FIC1}$")]
    assert formula_audit.structural_validator([("{", True), (r"\left(", True), (r"\begin{a}\end{b}", True), ("x", True)])[-1] is None
    ids = [r.formula_id for r in rows.collect()]
    assert len(set(ids)) == 4 and sorted(ids) == sorted(r.formula_id for r in formula_audit.scan_items(df).collect())


def test_markdown_table():
    assert table_to_html("|a|b|\n|-|:-:|\n|1|\n|2|3|4|").count("<td") == 4
    assert table_to_html("just text") is None and table_to_html("a|b\n1|2") is None


def test_safe_markdown():
    got = safe_markdown("# T $a<b$\n\n<script>x</script>\n\n<span>hi</span> [l](sub/p.md) ![i](../x.png) <a href='javascript:x' onclick='y'>z</a>\n\n- a\n- b\n\n`c`", "/base/")
    assert "<h1>T $a&lt;b$</h1>" in got and "script" not in got and "onclick" not in got and "javascript" not in got
    assert 'href="/base/sub/p.md"' in got and '<img alt="i">' in got and "<li>a</li>" in got and "<code>c</code>" in got


def test_a_failing_unit_leaves_no_cycle():
    """Frames held by an exception would stay until the collector runs, by the million."""
    import gc

    class Damaging:
        def translate(self, text, *, strict=False, response_format=None):
            return "nothing of it"

    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            translate.translate_text("a $x$ is. It is b.", "0" * 16, Damaging(), 1)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_units_are_dealt_over_tasks(spark):
    units = spark.range(64).coalesce(1).selectExpr("id doc_id", "'text' kind", "0 item_index", "'' field", "0 pos", "'a' text", "false is_empty")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert translate.run_units(units, UppercaseTranslator()).selectExpr("spark_partition_id()").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
