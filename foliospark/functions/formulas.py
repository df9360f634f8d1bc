"""Formulas in text: where they are, what looks wrong in them, how to repair it."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, per_value

SPAN = "struct<raw_formula:string,katex_formula:string,is_block:boolean,start:int,end:int,katex_start:int,katex_end:int>"

# Elements without content, the amount that isn't a formula, the signs of one that is.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)\b[^>]*>", re.DOTALL)
_AMOUNT = re.compile(r"\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?=[^A-Za-z0-9_]|$)")
_TEX_SIGN = re.compile(r"\\|[{}_^=+*/()<>]|\d\s*[-−]\s*\d")

# A run of backslashes with the delimiter behind it, read once from its start, or a dollar sign.
_MARK = re.compile(r"(?<!\\)(\\++)([\[\]()$])|\$")



def _first(places: list[int], start: int) -> int:
    """The first of sorted places from start on, or -1."""
    i = bisect_left(places, start)
    return places[i] if i < len(places) else -1


def scan_spans(text: str) -> list[tuple]:
    """Formula spans (raw, inner, is_block, start, end, inner start, inner end) of a text, from left to right, never overlapping.

    Delimiters are $$..$$ and \\[..\\] (blocks), \\(..\\) and $..$; an escaped one doesn't count. A lone $
    closes at the next $ that doesn't begin $$. $..$ is no formula if it holds a tag of an element with
    content, or begins like an amount and has no sign of TeX. The delimiters are indexed once, so the
    search is linear up to a logarithm.
    """
    if "$" not in text and ("\\" not in text or "\\(" not in text and "\\[" not in text):
        return []
    openers, double, single, square, rounded = [], [], [], [], []  # places that no backslash escapes
    if "\\" not in text or not ("\\$" in text or "\\(" in text or "\\)" in text or "\\[" in text or "\\]" in text):
        at = text.find("$")
        while at >= 0:
            (double if text.startswith("$", at + 1) else single).append(at)
            openers.append(at)
            at = text.find("$", at + 1)
    else:
        for m in _MARK.finditer(text):
            sign, odd = m[2], (m.end(1) - m.start()) % 2 if m[1] else 0
            if sign is None or sign == "$":
                if not odd:
                    at = m.end() - 1
                    (double if text.startswith("$", at + 1) else single).append(at)
                    openers.append(at)
            elif odd:
                (square if sign == "]" else rounded if sign == ")" else openers).append(m.end() - 2)
    spans, free = [], 0
    for at in openers:
        if at < free:
            continue
        two = text[at : at + 2]
        if two == "$$":
            close, width, block = _first(double, at + 2), 2, True
        elif two[0] == "$":
            close, width, block = _first(single, at + 1), 1, False
        else:
            close, width, block = _first(square if two[1] == "[" else rounded, at + 2), 2, two[1] == "["
        if close < 0:
            continue
        start = at + width
        inner = text[start:close]
        if width == 1:
            structural = "<" in inner and any(m.group(1).lower() not in VOID_TAGS for m in _TAG.finditer(inner))
            if structural or (_AMOUNT.match(inner) and not _TEX_SIGN.search(inner)):
                continue
        free = close + width
        spans.append((text[at:free], inner, block, at, free, start, close))
    return spans


_FIELDS = ("raw_formula", "katex_formula", "is_block", "start", "end", "katex_start", "katex_end")


def span_rows(text: str) -> list[dict]:
    return [dict(zip(_FIELDS, s, strict=True)) for s in scan_spans(text)]


#: Column of text -> array of formula spans.
formula_spans = per_value(span_rows, f"array<{SPAN}>")


def equation_span(text: Column) -> Column:
    """The one block formula that an equation's text is: inside $$..$$ or \\[..\\] if the trimmed text is wrapped so, else all of it."""
    lead = F.length(F.regexp_extract(text, rf"(?U)\A({SPACE}*)", 1))
    body = F.regexp_replace(F.regexp_replace(text, rf"(?U)\A{SPACE}+", ""), rf"(?U){SPACE}+\z", "")
    wrapped = body.rlike(r"(?s)\A(?:\$\$.*\$\$|\\\[.*\\\])\z") & (F.length(body) >= 4)
    inner = F.when(wrapped, F.substring(body, F.lit(3), F.length(body) - 4)).otherwise(text)
    start = F.when(wrapped, lead + 2).otherwise(F.lit(0))
    return F.struct(text.alias("raw_formula"), inner.alias("katex_formula"), F.lit(True).alias("is_block"), F.lit(0).alias("start"), F.length(text).alias("end"), start.cast("int").alias("katex_start"), (start + F.length(inner)).cast("int").alias("katex_end"))


def rebuild_raw(raw: Column, inner_start: Column, inner_end: Column, inner: Column) -> Column:
    """raw with another inner formula; places are counted from the start of raw."""
    return F.concat(F.substring(raw, F.lit(1), inner_start), inner, F.substring(raw, inner_end + 1, F.length(raw)))


def splice(text: str, pieces: list[tuple[int, int, str]]) -> str:
    """text with the pieces (start, end, new) put in; places refer to text."""
    out, at = [], 0
    for start, end, new in sorted(pieces):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def _replaced(text: str, replacements: list[dict] | None) -> str:
    if not replacements:
        return text
    table = {(r["raw_formula"], r["is_block"]): r["normalized"] for r in replacements}
    return splice(text, [(s[3], s[4], table[s[0], s[2]]) for s in scan_spans(text) if (s[0], s[2]) in table])


REPLACEMENTS = "array<struct<raw_formula:string,is_block:boolean,normalized:string>>"
_replace_spans = per_value(lambda text, r: None if text is None else _replaced(text, r), "string", nulls=True)


def replace_spans(text: Column, replacements: Column) -> Column:
    """text with every formula that an entry of replacements (raw_formula, is_block, normalized) names put right."""
    return _replace_spans(text, replacements)


#: (array of texts, replacements) -> the array with each text's formulas put right.
replace_spans_each = per_value(lambda texts, r: None if texts is None else [_replaced(t, r) for t in texts], "array<string>", nulls=True)


def replace_equation(text: Column, replacements: Column) -> Column:
    """The whole text of an equation, if replacements has it as a block; else text."""
    hit = F.filter(replacements, lambda r: (r["raw_formula"] == text) & r["is_block"])
    return F.when(F.size(F.coalesce(hit, F.array())) > 0, F.get(hit, F.lit(0))["normalized"]).otherwise(text)


# The rules by which a formula is suspicious, in this order, with their messages.
SUSPICIONS = (
    ("mineru_neqq", r"\\neqq(?![A-Za-z])", "\\neqq may stand for a misread C7 or the like"),
    ("mineru_complement", r"\\complement(?![A-Za-z])", "\\complement may stand for a misread C4 or the like"),
    ("max_inside_text", None, "\\max inside \\text{...}"),
    ("split_meter_max", r"Meter\s+Ma\s*(?:\^\s*\{\s*)?\\max(?![A-Za-z])(?:\s*\})?", "MeterMax may have been split and misread as \\max"),
    ("split_instrument_tag", r"(?<![A-Za-z])(?:F|H)\s+I\s+C(?![A-Za-z])", "an instrument tag may have been split by spaces"),
    ("split_cubic_meter_fraction", r"\\frac\s*\{\s*m\s+3\s*\}\s*\{\s*h\s*\}", "cubic metres an hour may have been misread as \\frac{m 3}{h}"),
)
# Where a text group begins, the sign that is suspicious in one.
_TEXT_OPEN = re.compile(r"\\text(?![A-Za-z])\s*\{")
_BRACE = re.compile(r"(\\*)([{}])")


def text_groups(formula: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost \\text{...} with balanced braces; an unclosed one doesn't count."""
    out, free = [], 0
    for m in _TEXT_OPEN.finditer(formula):
        if m.start() < free:
            continue
        depth = 1
        for b in _BRACE.finditer(formula, m.end()):
            if len(b.group(1)) % 2 == 0:
                depth += 1 if b.group(2) == "{" else -1
            if depth == 0:
                free = b.end()
                out.append((m.start(), free))
                break
    return out


# Fixed value: the operator that stands for letters in a text.
_MAX = re.compile(r"\\max(?![A-Za-z])")
max_in_text = per_value(lambda f: [m.group() for s, e in text_groups(f) for m in _MAX.finditer(f[s:e])], "array<string>")


def suspicions(formula: Column) -> Column:
    """array of (rule, message, matched_text), each match of each rule in order; one rule needs balanced braces and a Python function, the others are built in."""

    def listed(rule: str, pattern: str | None, message: str) -> Column:
        if pattern is None:  # Python sees those only that have the sign
            some = max_in_text(F.when(F.contains(formula, F.lit("\\max")), formula))
            found = F.when(formula.isNotNull(), F.coalesce(some, F.array().cast("array<string>")))
        else:
            found = F.regexp_extract_all(formula, F.lit(f"(?U){pattern}"), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"), m.alias("matched_text")))

    return F.concat(*(listed(*s) for s in SUSPICIONS))


def _spaced(word: str) -> str:
    return r"\s+".join(word)


# The repairs, in this order; a rule is named once however many of its patterns hit.
_CARBON = r"(?:\\mathsf\s*\{\s*C\s*\}|C)\s*_\s*\{\s*(\d+)\s*\}"
# The field names that are put right, with the letters that are read apart and what may stand for the rest.
FIELDS = (("MeterMax", "MeterMa", r"\s+(?:x|\\max(?![A-Za-z])|\^\s*\{\s*(?:\\max(?![A-Za-z])|" + _spaced("max") + r")\s*\})"), ("SetPoint", "SetPoint", ""), ("Output", "Output", ""), ("Equation", "Equation", ""))


def _fields(before: str, after: str) -> list[tuple[str, str]]:
    """(pattern, repair) of each field between two patterns, and no letter next to either."""
    return [(rf"(?<![A-Za-z]){before}(?:{_spaced(letters)}{rest}){after}(?![A-Za-z])", rf"\mathrm{{{name}}}") for name, letters, rest in FIELDS]


_IN_TEXT = _fields(r"\\text\s*\{\s*", r"\s*\}")
_BARE = [(re.compile(pattern), new) for pattern, new in _fields("", "")]
# A labelled equation.
_LABEL = r"(?<![A-Za-z])\\text\s*\{\s*" + _spaced("Equation") + r"\s+(\d+)\s*\}(?![A-Za-z])"
REPAIRS = (
    ("mineru_complement_subscript_c", r"\\complement(?![A-Za-z])\s*_\s*\{\s*(\d+)\s*\}", r"\\mathrm{C}_{$1}"),
    ("mineru_degree_complement_c", r"(\^\s*\{\s*\\circ(?![A-Za-z])\s*\})\s*\\complement(?![A-Za-z])", r"$1 \\mathrm{C}"),
    ("alkene_carbon_count_equality_pair", _CARBON + r"\s*\\neqq(?![A-Za-z])\s*/\s*" + _CARBON + r"\s*\\neq(?:q)?(?![A-Za-z])", r"\\mathrm{C}_{$1}^{=} / \\mathrm{C}_{$2}^{=}"),
)
FIELD_RULE, TAG_RULE, UNIT_RULE = "fixed_process_control_field", "numbered_instrument_tag", "cubic_metre_per_hour"
# Instrument tags and cubic metres an hour, as they are misread.
_TAG_NUMBER = r"(?<![A-Za-z0-9])([FH])\s+I\s+C\s+(\d(?:[ \t\r\n]*\d)*)(?![A-Za-z0-9])"
_UNIT = r"\\frac(?![A-Za-z])\s*\{\s*m\s+3\s*\}\s*\{\s*h\s*\}"


def _bare_fields(formula: str) -> str:
    """Bare field names outside \\text{...} replaced; a group is never looked into."""
    cuts = [0, *(p for g in text_groups(formula) for p in g), len(formula)]
    out = []
    for k, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = formula[start:end]
        if k % 2 == 0:
            for pattern, new in _BARE:
                part = pattern.sub(lambda _, new=new: new, part)
        out.append(part)
    return "".join(out)


bare_fields = per_value(_bare_fields, "string")
_join_tag = per_value(lambda f: re.sub(_TAG_NUMBER, lambda m: rf"\mathrm{{{m[1]}IC{''.join(m[2].split())}}}", f), "string")


def _where(pattern: str, change: Callable[[Column], Column], c: Column) -> Column:
    """change(c) of values in which a pattern of Python's is found; the others are left alone, without Python. Its white space is read as Python does."""
    wide = pattern.replace(r"\s", SPACE)
    return F.coalesce(change(F.when(c.rlike(f"(?U){wide}"), c)), c)


def repair(df: DataFrame, formula: str, fixed: str = "normalized_formula", rules: str = "normalization_rules") -> DataFrame:
    """df with the repaired formula and the names of the rules that hit. Repairing the result again changes nothing."""
    step, names = df.withColumn("__f", F.col(formula)), []

    def change(step: DataFrame, rule: str, new: Column) -> DataFrame:
        names.append(rule)
        hit = f"__{len(names)}"
        step = step.withColumn("__next", new)
        return step.withColumn(hit, F.when(F.col("__next") != F.col("__f"), rule)).withColumn("__f", F.col("__next"))

    for rule, pattern, new in REPAIRS:
        step = change(step, rule, F.regexp_replace("__f", f"(?U){pattern}", new))
    fields = F.regexp_replace("__f", f"(?U){_LABEL}", r"\\mathrm{Equation\\,$1}")
    for pattern, new in _IN_TEXT:
        fields = F.regexp_replace(fields, f"(?U){pattern}", new.replace("\\", "\\\\"))
    bare = "|".join(pattern.pattern for pattern, _ in _BARE)
    step = change(step, FIELD_RULE, _where(bare, bare_fields, fields))
    step = change(step, TAG_RULE, _where(_TAG_NUMBER, _join_tag, F.col("__f")))
    step = change(step, UNIT_RULE, F.regexp_replace("__f", f"(?U){_UNIT}", r"\\frac{\\mathrm{m}^{3}}{\\mathrm{h}}"))
    found = F.array_compact(F.array(*(F.col(f"__{i + 1}") for i in range(len(names)))))
    return step.select(*df.columns, F.col("__f").alias(fixed), found.alias(rules))
