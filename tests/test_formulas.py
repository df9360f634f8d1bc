import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import formulas
from foliospark.functions.formulas import scan_spans


def test_four_delimiters():
    spans = scan_spans(r"a $x$ b $$y$$ c \(z\) d \[w\]")
    assert [(s[0], s[1], s[2]) for s in spans] == [("$x$", "x", False), ("$$y$$", "y", True), (r"\(z\)", "z", False), (r"\[w\]", "w", True)]


@pytest.mark.parametrize("text", ["$5 and $10", "costs $1,000.50 to $2,000", "$5 million in $ total", "a <td>$x</td><td>y$</td>", r"\$x\$", "$x", "$$x", r"\(x", r"\[x", r"\\(x\\)", "x$", "$"])
def test_no_formula(text):
    assert scan_spans(text) == []


def test_quirks():
    assert [s[0] for s in scan_spans("$a$$")] == ["$a$$"]
    assert [s[0] for s in scan_spans("$5$ or $x_5$")] == ["$ or $"]  # a rejected opener moves on by one character
    assert [s[0] for s in scan_spans("$a<br>b$")] == ["$a<br>b$"]
    assert [s[0] for s in scan_spans("$5 - 3$")] == ["$5 - 3$"]


@given(st.text("$\\()[] ax5,<b>"))
def test_spans_are_in_bounds_and_apart(text):
    end = 0
    for raw, inner, block, start, stop, a, b in scan_spans(text):
        assert end <= start < a <= b < stop <= len(text) and text[start:stop] == raw and text[a:b] == inner
        end = stop


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,inner,start", [("x^2", "x^2", 0), (" $$x$$ ", "x", 3), ("\\[y\\]", "y", 2), ("$$", "$$", 0), ("$$$$", "", 2), ("$x$", "$x$", 0)])
def test_equation(spark, text, inner, start):
    got = one(spark, text, formulas.equation_span)
    assert (got.katex_formula, got.katex_start, got.katex_end, got.is_block) == (inner, start, start + len(inner), True)


def repaired(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, f string")
    return [(r.normalized_formula, r.normalization_rules) for r in formulas.repair(df, "f").orderBy("i").collect()]


CASES = [
    (r"\complement _ { 4 }", r"\mathrm{C}_{4}", "mineru_complement_subscript_c"),
    (r"20 ^ { \circ } \complement", r"20 ^ { \circ } \mathrm{C}", "mineru_degree_complement_c"),
    (r"C _ { 3 } \neqq / C _ { 4 } \neq", r"\mathrm{C}_{3}^{=} / \mathrm{C}_{4}^{=}", "alkene_carbon_count_equality_pair"),
    (r"\text { E q u a t i o n 1 2 }".replace("1 2", "12"), r"\mathrm{Equation\,12}", "fixed_process_control_field"),
    (r"M e t e r M a \max", r"\mathrm{MeterMax}", "fixed_process_control_field"),
    (r"\text{ S e t P o i n t }", r"\mathrm{SetPoint}", "fixed_process_control_field"),
    (r"F I C 1 0 2", r"\mathrm{FIC102}", "numbered_instrument_tag"),
    (r"\frac { m 3 } { h }", r"\frac{\mathrm{m}^{3}}{\mathrm{h}}", "cubic_metre_per_hour"),
]


def test_repairs_and_a_second_pass_changes_nothing(spark):
    first = repaired(spark, *(c[0] for c in CASES))
    assert first == [(c[1], [c[2]]) for c in CASES]
    assert [r for _, r in repaired(spark, *(f for f, _ in first))] == [[]] * len(CASES)


@pytest.mark.parametrize("text", [r"\complement A", r"\text{see O u t p u t here}", "XF I C 1", r"\neqq", "C_{3}"])
def test_left_alone(spark, text):
    assert repaired(spark, text) == [(text, [])]


def test_suspicions(spark):
    got = one(spark, r"\neqq \complement \text{a \max {b}} Meter Ma ^ { \max } F I C \frac{m 3}{h}", formulas.suspicions)
    assert [m.rule for m in got] == ["mineru_neqq", "mineru_complement", "max_inside_text", "split_meter_max", "split_instrument_tag", "split_cubic_meter_fraction"]
    assert one(spark, r"\neqqx \max \text{open \max", formulas.suspicions) == []


def test_replacement_by_content(spark):
    df = spark.createDataFrame([("a $x$ b $x$ $$x$$ \\$x", [("$x$", False, "$y$")])], "t string, r array<struct<raw_formula:string,is_block:boolean,normalized:string>>")
    assert df.select(formulas.replace_spans(F.col("t"), F.col("r")).alias("x")).first().x == "a $y$ b $y$ $$x$$ \\$x"
    assert df.select(formulas.replace_equation(F.lit("$x$"), F.col("r")).alias("x")).first().x == "$x$"
