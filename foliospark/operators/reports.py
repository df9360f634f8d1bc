"""Audit reports as JSON documents, one a document: writing them, and reading them with every rule that they have to keep."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formula_audit

# The members of a report, of its summary and of its records, in versions 1 and 2.
REPORT_KEYS = ["schema_version", "validator", "summary", "problem_page_indices", "invalid_syntax_page_indices", "suspicious_page_indices", "formulas", "issues"]
PAGE_KEYS = ["problem_page_indices", "invalid_syntax_page_indices", "suspicious_page_indices"]
LEGACY_SUMMARY_KEYS = ["total_formulas", "valid_count", "invalid_syntax_count", "suspicious_count", "issue_formula_count"]
SUMMARY_KEYS = [*LEGACY_SUMMARY_KEYS, "scanned_formula_count", "matched_formula_count", "normalization_accepted_count", "normalization_rejected_count"]
_PLACE = {
    "formula_id": "string", "page_idx": "bigint", "bbox": "variant", "source_type": "string", "field_path": "string", "table_row_idx": "int", "table_col_idx": "int", "cell_tag": "string", "formula_index": "int", "raw_formula": "string", "is_block": "boolean", "content_hash": "string",
    "syntax_status": "string", "suspicious": "boolean", "statuses": "array<string>", "suspicion_rules": "array<struct<rule:string,message:string,matched_text:string>>", "validation_error": "string", "normalized_formula": "string",
}
LEGACY_RECORD = _PLACE | {"normalization_rule": "string", "confidence": "double"}
RECORD = _PLACE | {"raw_validation_error": "string", "normalization_rules": "array<string>", "normalization_status": "string"}
VALIDATOR = {"name": "structural", "version": "1", "config": {}}


def _record(names: dict) -> Column:
    return F.struct(*(F.parse_json("bbox").alias("bbox") if n == "bbox" else F.col(n) for n in names))


def report_documents(records: DataFrame, validator: dict | None = None) -> DataFrame:
    """doc_id, value: the report of each document that has formulas, as JSON. Records go by their place in the document."""
    place = ["item_index", "table_row_idx", "table_col_idx", "formula_index"]
    entry = F.struct(*place, _record(RECORD).alias("record"), formula_audit.is_issue().alias("issue"))
    listed = records.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*place, F.to_json(entry["record"], {"ignoreNullFields": "false"}).alias("json"), entry["issue"].alias("issue")))).alias("all"))
    summed = formula_audit.summary(records).withColumnRenamed("doc_id", "__doc")
    joined = listed.join(summed, F.col("doc_id").eqNullSafe(F.col("__doc")))
    texts = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: x["json"]), ","), F.lit("]"))
    parts = [F.lit('{"schema_version":2,"validator":' + json.dumps(validator or VALIDATOR, ensure_ascii=False, separators=(",", ":")) + ',"summary":'), F.to_json(F.struct(*SUMMARY_KEYS))]
    for name in PAGE_KEYS:
        parts += [F.lit(f',"{name}":'), F.to_json(name)]
    parts += [F.lit(',"formulas":'), texts(F.col("all")), F.lit(',"issues":'), texts(F.filter("all", lambda x: x["issue"])), F.lit("}")]
    return joined.select("doc_id", F.concat(*parts).alias("value"))


def _same(keys: Column, names: list[str]) -> Column:
    return F.coalesce(F.array_sort(keys) == F.array(*(F.lit(n) for n in sorted(names))), F.lit(False))


def _expected(formulas: Column, version: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """(summary, page lists) of an array of records."""
    invalid = lambda r: r["syntax_status"] == "invalid_syntax"
    decided = lambda *which: lambda r: r["normalization_status"].isin(*which)
    issue = lambda r: invalid(r) | r["suspicious"] | (decided("accepted", "rejected")(r) if version == 2 else F.lit(False))
    n = lambda f: F.size(F.filter(formulas, f)).cast("bigint")
    pages = lambda f: F.array_sort(F.array_compact(F.array_distinct(F.transform(F.filter(formulas, f), lambda r: r["page_idx"]))))
    sums = {"total_formulas": F.size(formulas).cast("bigint"), "valid_count": n(lambda r: r["syntax_status"] == "valid"), "invalid_syntax_count": n(invalid), "suspicious_count": n(lambda r: r["suspicious"]), "issue_formula_count": n(issue)}
    if version == 2:
        sums |= {"scanned_formula_count": F.size(formulas).cast("bigint"), "matched_formula_count": n(decided("accepted", "rejected")), "normalization_accepted_count": n(decided("accepted")), "normalization_rejected_count": n(decided("rejected"))}
    return sums, {"problem_page_indices": pages(issue), "invalid_syntax_page_indices": pages(invalid), "suspicious_page_indices": pages(lambda r: r["suspicious"])}


def _report_error(version: int, validator: dict) -> Column:
    """What is wrong with a report of a version as a whole: other members, another validator, records with other members, issues that aren't the formulas with a problem, a summary or page lists other than the records give; null if nothing."""
    names = LEGACY_RECORD if version == 1 else RECORD
    record = "struct<" + ",".join(f"{k}:{v}" for k, v in names.items()) + ">"
    part = lambda name: F.get_json_object("value", f"$.{name}")
    array = lambda name: F.from_json(part(name), "array<variant>")
    closed = lambda name: F.forall(array(name), lambda v: _same(F.json_object_keys(F.to_json(v)), list(names)))
    formulas = F.from_json(part("formulas"), f"array<{record}>")
    sums, pages = _expected(formulas, version)
    summary = F.from_json(part("summary"), "struct<" + ",".join(f"{k}:bigint" for k in sums) + ">")
    problem = lambda v: (F.try_variant_get(v, "$.syntax_status", "string") == "invalid_syntax") | F.try_variant_get(v, "$.suspicious", "boolean") | (F.coalesce(F.try_variant_get(v, "$.normalization_status", "string"), F.lit("")).isin("accepted", "rejected") if version == 2 else F.lit(False))
    told = F.transform(array("issues"), lambda v: F.to_json(v))
    due = F.transform(F.filter(array("formulas"), problem), lambda v: F.to_json(v))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(~_same(F.json_object_keys("value"), REPORT_KEYS), "other members")
        .when(no(F.to_json(F.parse_json(part("validator"))) == F.to_json(F.parse_json(F.lit(json.dumps(validator))))), "another validator")
        .when(~_same(F.json_object_keys(part("summary")), list(sums)), "a summary of other members")
        .when(no(F.forall(array("formulas"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))) | no(F.forall(array("issues"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))), "a record that is no object")
        .when(no(closed("formulas")) | no(closed("issues")), "a record of other members")
        .when(no(told == due), "the issues are not the formulas with a problem")
        .when(no(F.forall(F.array(*(F.coalesce(summary[k] == v, F.lit(False)) for k, v in sums.items())), lambda x: x)), "the summary does not match")
        .when(no(F.forall(F.array(*(F.coalesce(F.from_json(part(k), "array<bigint>") == v, F.lit(False)) for k, v in pages.items())), lambda x: x)), "the page lists do not match")
    )


def read_reports(reports: DataFrame, validator: dict | None = None) -> DataFrame:
    """doc_id, version, error for each of reports(doc_id, value): version 2, or 1, which has to be built anew; null with an error for anything else. The error is that of the report as a whole, else the first (by formula_id) of its records; null if there is none."""
    asked = validator or VALIDATOR
    readable = F.try_parse_json("value")
    version = F.get_json_object("value", "$.schema_version")
    known = F.when(readable.isNull(), "no JSON").when(~F.coalesce(version.isin("1", "2"), F.lit(False)), "unknown version")
    whole = F.coalesce(known, F.when(version == "1", _report_error(1, asked)).otherwise(_report_error(2, asked)))
    checked = reports.select("doc_id", "value", F.when(known.isNull(), version.cast("int")).alias("version"), whole.alias("whole"))
    of_records = None
    for number, names, errors in ((1, LEGACY_RECORD, formula_audit.legacy_record_errors), (2, RECORD, formula_audit.record_errors)):
        record = "array<struct<" + ",".join(f"{k}:{v}" for k, v in names.items()) + ">>"
        rows = checked.filter((F.col("version") == number) & F.col("whole").isNull()).select("doc_id", F.explode(F.from_json(F.get_json_object("value", "$.formulas"), record)).alias("r")).select("doc_id", "r.*").drop("bbox")
        found = errors(rows)
        of_records = found if of_records is None else of_records.unionByName(found)
    first = of_records.groupBy(F.col("doc_id").alias("__doc")).agg(F.min_by("error", F.coalesce("formula_id", F.lit(""))).alias("of_record"))
    return checked.join(first, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").select("doc_id", "version", F.coalesce("whole", "of_record").alias("error"))
