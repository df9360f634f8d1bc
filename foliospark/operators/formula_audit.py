"""Formula candidates of content items, their audit with a pluggable validator, reports and replacements."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ContentError
from ..functions.formulas import equation_span, formula_spans, rebuild_raw, repair, suspicions
from ..functions.tables import table_formulas
from ..functions.text import per_value
from ..session import join_counted, materialise

CANDIDATE_COLUMNS = [
    "doc_id", "item_index", "formula_id", "page_idx", "bbox", "source_type", "field_path", "table_row_idx", "table_col_idx", "cell_tag", "formula_index",
    "raw_start", "raw_formula", "katex_formula", "katex_start", "katex_end", "is_block", "content_hash",
]


_EXAMINED = ["syntax_status", "suspicious", "statuses", "suspicion_rules"]
RECORD_COLUMNS = [*CANDIDATE_COLUMNS, *_EXAMINED, "raw_validation_error", "normalized_formula", "normalization_rules", "normalization_status", "validation_error"]
LEGACY_COLUMNS = [*CANDIDATE_COLUMNS, *_EXAMINED, "validation_error", "normalized_formula", "normalization_rule", "confidence"]

#: JSON text in one form: no spaces, sorted keys.
_one_form = per_value(lambda v: json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")), "string")


def _ids(page: Column, bbox: Column, source: Column, path: Column, row: Column, col: Column, number: Column, digest: Column) -> Column:
    """formula_ and 24 hex digits of a hash of place and content, written as JSON in one form. Only boxes that aren't plain lists of integers go through Python."""
    plain = bbox.rlike(r"\A\[\s*(?:-?(?:0|[1-9][0-9]*)(?:\s*,\s*-?(?:0|[1-9][0-9]*))*)?\s*\]\z")
    box = F.when(plain, F.regexp_replace(bbox, r"\s", "")).otherwise(_one_form(F.when(~plain, bbox)))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    members = {"bbox": shown(box), "content_hash": quoted(digest), "field_path": quoted(path), "formula_index": shown(number), "page_idx": shown(page), "source_type": quoted(source), "table_col_idx": shown(col), "table_row_idx": shown(row)}
    parts = [x for k, v in members.items() for x in (F.lit(f'{"," if k != "bbox" else "{"}"{k}":'), v)]
    return F.concat(F.lit("formula_"), F.left(F.sha2(F.concat(*parts, F.lit("}")), 256), F.lit(24)))


def scan_items(items: DataFrame) -> DataFrame:
    """A row for each formula of items: the whole text of an equation, the spans of any other text, the spans in the visible cells of a table body. A table that can't be read fails the query with its place, as the document can't be audited.

    formula_id is a hash of the formula's place and content, so it is the same in every run.
    """
    base = items.select("doc_id", "item_index", "type", "text", "page_idx", "bbox", "table_body")
    path = lambda field: F.concat(F.lit("/"), F.col("item_index").cast("string"), F.lit(f"/{field}"))
    none = F.lit(None).cast("int")
    texts = base.filter(F.col("text").isNotNull())
    equations = texts.filter("type = 'equation'").select("doc_id", "item_index", "page_idx", "bbox", F.lit("equation").alias("source_type"), path("text").alias("field_path"), none.alias("row"), none.alias("col"), F.lit(None).cast("string").alias("cell_tag"), F.lit(0).alias("formula_index"), equation_span(F.col("text")).alias("span"))
    plain = texts.filter("type is null or type <> 'equation'").filter(F.contains("text", F.lit("$")) | F.contains("text", F.lit("\\")))
    spans = plain.select("doc_id", "item_index", "page_idx", "bbox", F.lit("text").alias("source_type"), path("text").alias("field_path"), none.alias("row"), none.alias("col"), F.lit(None).cast("string").alias("cell_tag"), F.posexplode(formula_spans("text")).alias("formula_index", "span"))
    read = base.filter(F.col("table_body").isNotNull()).withColumn("t", table_formulas("table_body"))
    checked = F.when(F.col("t.error").isNotNull(), F.raise_error(F.concat(path("table_body"), F.lit(": "), F.col("t.error"))).cast("array<struct<row_idx:int,col_idx:int,cell_tag:string,formula_index:int,span:struct<raw_formula:string,katex_formula:string,is_block:boolean,start:int,end:int,katex_start:int,katex_end:int>>>")).otherwise(F.col("t.formulas"))
    cells = read.select("doc_id", "item_index", "page_idx", "bbox", F.lit("table_cell").alias("source_type"), path("table_body").alias("field_path"), F.explode(checked).alias("f")).select("doc_id", "item_index", "page_idx", "bbox", "source_type", "field_path", F.col("f.row_idx").alias("row"), F.col("f.col_idx").alias("col"), "f.cell_tag", "f.formula_index", "f.span")
    found = equations.unionByName(spans).unionByName(cells)
    digest = F.sha2(F.col("span.raw_formula"), 256)
    rows = found.withColumn("content_hash", digest)
    ids = _ids(F.col("page_idx"), F.col("bbox"), F.col("source_type"), F.col("field_path"), F.col("row"), F.col("col"), F.col("formula_index"), F.col("content_hash"))
    return rows.withColumn("formula_id", ids).select(
        "doc_id", "item_index", "formula_id", "page_idx", "bbox", "source_type", "field_path", F.col("row").alias("table_row_idx"), F.col("col").alias("table_col_idx"), "cell_tag", F.col("formula_index").cast("int").alias("formula_index"),
        F.col("span.start").alias("raw_start"), "span.raw_formula", "span.katex_formula", (F.col("span.katex_start") - F.col("span.start")).alias("katex_start"), (F.col("span.katex_end") - F.col("span.start")).alias("katex_end"), "span.is_block", "content_hash",
    )


# -- validation

#: A validator takes (formula, is_block) pairs and gives, in order, null for a valid one or the error.
Validator = Callable[[list[tuple[str, bool]]], list[str | None]]


def structural_validator(formulas: list[tuple[str, bool]]) -> list[str | None]:
    """Checks braces, \\left/\\right and \\begin/\\end only; a full TeX validator is a plug-in of the same form."""
    import re

    out: list[str | None] = []
    for formula, _ in formulas:
        depth, error = 0, None
        for m in re.finditer(r"\\.|[{}]", formula, re.S):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if depth < 0:
                error = "unexpected }"
                break
        if error is None and depth:
            error = "missing }"
        if error is None and len(re.findall(r"\\left(?![A-Za-z])", formula)) != len(re.findall(r"\\right(?![A-Za-z])", formula)):
            error = "\\left without \\right"
        if error is None:
            opened: list[str] = []
            for kind, name in re.findall(r"\\(begin|end)\s*\{([^}]*)\}", formula):
                if kind == "begin":
                    opened.append(name)
                elif not opened or opened.pop() != name:
                    error = f"unmatched end of {name}"
                    break
            error = error or (f"no end of {opened[-1]}" if opened else None)
        out.append(error)
    return out


def checked(validator: Validator, pairs: list[tuple[str, bool]]) -> list[str | None]:
    """The validator's results for pairs; a wrong number of results or an empty error is an error of the run."""
    errors = validator(pairs) if pairs else []
    if len(errors) != len(pairs) or any(e is not None and not (isinstance(e, str) and e) for e in errors):
        raise ValueError("the validator broke its contract")
    return errors


def validate(formulas: DataFrame, validator: Validator) -> DataFrame:
    """formulas(formula, is_block, fixed, ...) with raw_validation_error and, where fixed differs from formula, fixed_error, null for valid ones. One call a batch for the formulas and one for the changed ones; nothing is shuffled."""
    names, types = formulas.columns, formulas.schema
    at = {c: names.index(c) for c in ("formula", "is_block", "fixed")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formula, is_block, fixed = (batch.column(at[c]).to_pylist() for c in ("formula", "is_block", "fixed"))
            changed = [i for i, f in enumerate(formula) if fixed[i] != f]
            errors = checked(validator, list(zip(formula, is_block, strict=True)))
            again: list[str | None] = [None] * len(formula)
            for i, e in zip(changed, checked(validator, [(fixed[i], is_block[i]) for i in changed]), strict=True):
                again[i] = e
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string()), pa.array(again, pa.string())], [*names, "raw_validation_error", "fixed_error"])

    return formulas.mapInArrow(run, StructType([*types.fields]).add("raw_validation_error", "string").add("fixed_error", "string"))


def audit(candidates: DataFrame, validator: Validator = structural_validator) -> DataFrame:
    """candidates with syntax_status, suspicion_rules, suspicious, statuses, normalized_formula, normalization_rules, normalization_status and validation_error.

    Each distinct formula is examined, repaired and validated once; of the repaired ones only those that
    changed. A repair is accepted if the validator passes it, else rejected; not_applicable without one.
    Candidates are a table in the shared folder before they are used twice, and a formula that many of
    them have is joined by broadcast.
    """
    candidates = materialise(candidates.select(*CANDIDATE_COLUMNS), "candidates")
    distinct = candidates.groupBy("katex_formula", "is_block").agg(F.count(F.lit(1)).alias("uses")).withColumnRenamed("katex_formula", "formula")
    examined = repair(distinct, "formula", "fixed", "normalization_rules").withColumn("suspicion_rules", suspicions(F.col("formula")))
    known = materialise(validate(examined, validator).withColumnRenamed("formula", "katex_formula"), "formulas")
    rows = join_counted(candidates, known, ["katex_formula", "is_block"], "uses")
    is_changed = F.col("fixed") != F.col("katex_formula")
    status = F.when(~is_changed, "not_applicable").when(F.col("fixed_error").isNull(), "accepted").otherwise("rejected")
    syntax = F.when(F.col("raw_validation_error").isNull(), "valid").otherwise("invalid_syntax")
    suspicious = F.size("suspicion_rules") > 0
    return rows.select(
        *CANDIDATE_COLUMNS,
        syntax.alias("syntax_status"),
        suspicious.alias("suspicious"),
        F.array_compact(F.array(syntax, F.when(suspicious, "suspicious"))).alias("statuses"),
        "suspicion_rules",
        "raw_validation_error",
        F.when(is_changed, rebuild_raw(F.col("raw_formula"), F.col("katex_start"), F.col("katex_end"), F.col("fixed"))).alias("normalized_formula"),
        "normalization_rules",
        status.alias("normalization_status"),
        F.when(is_changed, F.col("fixed_error")).alias("validation_error"),
    )


def is_issue() -> Column:
    return (F.col("syntax_status") == "invalid_syntax") | F.col("suspicious") | F.col("normalization_status").isin("accepted", "rejected")


def summary(records: DataFrame) -> DataFrame:
    """Counters and sorted page lists of each document, in one aggregate."""
    invalid, repaired = F.col("syntax_status") == "invalid_syntax", F.col("normalization_status").isin("accepted", "rejected")
    pages = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("page_idx"))))
    return records.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_formulas"),
        F.count(F.lit(1)).alias("scanned_formula_count"),
        F.count_if(F.col("syntax_status") == "valid").alias("valid_count"),
        F.count_if(invalid).alias("invalid_syntax_count"),
        F.count_if(F.col("suspicious")).alias("suspicious_count"),
        F.count_if(is_issue()).alias("issue_formula_count"),
        F.count_if(repaired).alias("matched_formula_count"),
        F.count_if(F.col("normalization_status") == "accepted").alias("normalization_accepted_count"),
        F.count_if(F.col("normalization_status") == "rejected").alias("normalization_rejected_count"),
        pages(is_issue()).alias("problem_page_indices"),
        pages(invalid).alias("invalid_syntax_page_indices"),
        pages(F.col("suspicious")).alias("suspicious_page_indices"),
    )


def accepted_replacements(records: DataFrame) -> DataFrame:
    """doc_id, raw_formula, is_block, normalized: the accepted repairs of each document by content. Two decisions on one content fail the query."""
    decided = records.filter("normalization_status in ('accepted', 'rejected')")
    one = decided.groupBy("doc_id", "raw_formula", "is_block").agg(F.min(F.struct("normalized_formula", "normalization_status")).alias("a"), F.max(F.struct("normalized_formula", "normalization_status")).alias("b"))
    clash = F.raise_error(F.concat(F.lit("conflicting decisions on "), F.col("raw_formula"))).cast("string")
    checked = one.withColumn("normalized", F.when(F.col("a") == F.col("b"), F.col("a.normalized_formula")).otherwise(clash))
    return checked.filter(F.col("a.normalization_status") == "accepted").select("doc_id", "raw_formula", "is_block", "normalized")


def replacement_lists(replacements: DataFrame) -> DataFrame:
    """doc_id, replacements: the array that the replacing functions take."""
    entry = F.struct("raw_formula", "is_block", "normalized")
    return replacements.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("replacements"))


def replace_in_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """items with their texts' accepted repairs put in at the places that the records name, for items that are as they were when they were audited. An equation is one formula; others are spliced from left to right, in built-in functions."""
    own = records.filter("normalization_status = 'accepted' and source_type in ('text', 'equation')")
    edit = F.struct(F.col("raw_start").alias("start"), (F.col("raw_start") + F.length("raw_formula")).alias("end"), F.col("normalized_formula").alias("new"))
    edits = own.groupBy("doc_id", "item_index").agg(F.array_sort(F.collect_list(edit)).alias("__edits"))
    joined = items.join(edits, ["doc_id", "item_index"], "left")
    before = lambda i: F.when(i > 0, F.get("__edits", i - 1)["end"]).otherwise(F.lit(0))
    parts = F.transform("__edits", lambda e, i: F.concat(F.substring("text", before(i) + 1, e["start"] - before(i)), e["new"]))
    tail = F.substring(F.col("text"), F.element_at("__edits", -1)["end"] + 1, F.length("text"))
    text = F.when(F.col("__edits").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return joined.withColumn("text", text).select(*items.columns)


def record_errors(records: DataFrame) -> DataFrame:
    """formula records that contradict themselves, with error: an incomplete place, an unknown status, statuses that don't match, an error with a valid formula or none with an invalid one, a repair without text, rule or verdict, repeated rules, an id given twice. Columns a version 2 record has; report_version tells the older ones."""
    per_id = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "formula_id"))
    status, norm = F.col("syntax_status"), F.col("normalization_status")
    rest = (
        F.when((status == "valid") & F.col("raw_validation_error").isNotNull(), "an error with a valid formula")
        .when((status == "invalid_syntax") & (F.coalesce(F.col("raw_validation_error"), F.lit("")) == ""), "no error with an invalid formula")
        .when(~norm.isin("not_applicable", "accepted", "rejected") | norm.isNull(), "unknown normalization status")
        .when((norm == "not_applicable") & (F.col("normalized_formula").isNotNull() | (F.size("normalization_rules") > 0) | F.col("validation_error").isNotNull()), "a repair that is not applicable")
        .when((norm != "not_applicable") & ((F.coalesce(F.col("normalized_formula"), F.lit("")) == "") | (F.size("normalization_rules") == 0)), "a repair without text or rule")
        .when((norm != "not_applicable") & (F.col("normalized_formula") == F.col("raw_formula")), "a repair that changes nothing")
        .when(F.exists("normalization_rules", lambda r: r.isNull() | (r == "")), "a rule without a name")
        .when((norm == "accepted") & F.col("validation_error").isNotNull(), "an error with an accepted repair")
        .when((norm == "rejected") & (F.coalesce(F.col("validation_error"), F.lit("")) == ""), "no error with a rejected repair")
        .when(F.size(F.array_distinct("normalization_rules")) < F.size("normalization_rules"), "a rule is named twice")
        .when(F.col("content_hash") != F.sha2("raw_formula", 256), "wrong content hash")
        .when(per_id > 1, "formula_id given twice")
    )
    error = F.coalesce(_location_error(), _suspicion_error(), rest)
    return records.withColumn("error", error).filter("error is not null").select("doc_id", "formula_id", "error")


def _location_error() -> Column:
    """What is wrong with the place and kind of a formula record, whichever version it has; null if nothing."""
    cell = F.col("source_type") == "table_cell"
    count = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    none = F.col("table_row_idx").isNull() & F.col("table_col_idx").isNull() & F.col("cell_tag").isNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(F.col("formula_id").rlike(r"\Aformula_[0-9a-f]{24}\z")), "no formula_id")
        .when(no(F.col("content_hash").rlike(r"\A[0-9a-f]{64}\z")), "no content hash")
        .when(no(F.col("source_type").isin("equation", "text", "table_cell")), "unknown source type")
        .when(no(F.startswith("field_path", F.lit("/"))) | ~count("formula_index") | F.col("raw_formula").isNull() | F.col("is_block").isNull() | F.col("suspicious").isNull(), "an incomplete place")
        .when(cell & no(count("table_row_idx") & count("table_col_idx") & F.col("cell_tag").isin("td", "th")), "a table cell without its place")
        .when(~cell & ~none, "a place in a table without a table")
    )


def _suspicion_error() -> Column:
    status = F.col("syntax_status")
    expected = F.array_compact(F.array(status, F.when(F.col("suspicious"), "suspicious")))
    blank = F.exists("suspicion_rules", lambda r: r["rule"].isNull() | r["message"].isNull() | r["matched_text"].isNull())
    return (
        F.when(status.isNull() | ~status.isin("valid", "invalid_syntax"), "unknown syntax status")
        .when(F.coalesce(F.col("suspicious") != (F.size("suspicion_rules") > 0), F.lit(True)), "suspicious does not match its rules")
        .when(F.coalesce(F.col("statuses") != expected, F.lit(True)), "statuses do not match")
        .when(blank, "an incomplete suspicion")
    )


def legacy_record_errors(records: DataFrame) -> DataFrame:
    """doc_id, formula_id, error of version 1 records that contradict themselves. They name one repair at most, which version 1 never made: normalized_formula, normalization_rule and confidence are null, validation_error is that of the formula."""
    per_id = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "formula_id"))
    valid = F.col("syntax_status") == "valid"
    error = F.coalesce(
        _location_error(),
        _suspicion_error(),
        F.when(valid & F.col("validation_error").isNotNull(), "an error with a valid formula")
        .when(~valid & (F.coalesce(F.col("validation_error"), F.lit("")) == ""), "no error with an invalid formula")
        .when(F.col("normalized_formula").isNotNull() | F.col("normalization_rule").isNotNull() | F.col("confidence").isNotNull(), "a repair in a version without repairs")
        .when(per_id > 1, "formula_id given twice"),
    )
    return records.withColumn("error", error).filter("error is not null").select("doc_id", "formula_id", "error")


def report_errors(records: DataFrame, summaries: DataFrame) -> DataFrame:
    """doc_id, error of summaries that aren't what their records give: counters and page lists are computed anew and compared."""
    mine, names = summary(records), [c for c in summaries.columns if c != "doc_id"]
    joined = mine.select("doc_id", F.struct(*names).alias("mine")).join(summaries.select("doc_id", F.struct(*names).alias("theirs")), "doc_id", "full_outer")
    error = F.when(F.col("mine").isNull(), "a report without formulas").when(F.col("theirs").isNull(), "no report").when(F.col("mine") != F.col("theirs"), "the summary does not match")
    return joined.select("doc_id", error.alias("error")).filter("error is not null")


def report_version(columns: list[str]) -> int:
    """2 for exactly the columns of a current record, 1 for those of a record with one normalization_rule and confidence; other columns, missing ones or more, are an error."""
    own = set(columns)
    if own == set(RECORD_COLUMNS):
        return 2
    if own == set(LEGACY_COLUMNS):
        return 1
    raise ContentError("not an audit report: " + ", ".join(sorted(own ^ set(RECORD_COLUMNS))))
