"""Reports as JSON: what is written is read without error, and each damage is found."""

import json

import pytest

from foliospark.operators import formula_audit as fa
from foliospark.operators import reports

from .test_checkpoints_and_audit import Rejecting


@pytest.fixture(scope="module")
def report(spark):
    from foliospark.sources.content import parse_items

    given = [{"type": "text", "text": "a $F I C 1$ and $x$", "page_idx": 3, "bbox": [1, 2.5]}, {"type": "table", "table_body": "<table><tr><td>$\\neqq$ $y$</td></tr></table>", "page_idx": 2}, {"type": "equation", "text": "$$F I C 2$$"}]
    items = parse_items(spark.createDataFrame([("d", json.dumps(given))], "doc_id string, value string"))
    records = fa.audit(fa.scan_items(items), Rejecting("x", r"\mathrm{FIC2}"))
    return json.loads(reports.report_documents(records).first().value)


def legacy(report):
    old = json.loads(json.dumps(report)) | {"schema_version": 1}
    old["summary"] = {k: v for k, v in old["summary"].items() if k in reports.LEGACY_SUMMARY_KEYS}
    for name in ("formulas", "issues"):
        for r in old[name]:
            r |= {"validation_error": r.pop("raw_validation_error"), "normalized_formula": None, "normalization_rule": None, "confidence": None}
            del r["normalization_rules"], r["normalization_status"]
    old["issues"] = [r for r in old["formulas"] if r["syntax_status"] == "invalid_syntax" or r["suspicious"]]
    old["summary"]["issue_formula_count"] = len(old["issues"])
    old["problem_page_indices"] = sorted({r["page_idx"] for r in old["issues"] if r["page_idx"] is not None})
    return old


def test_form(report):
    assert list(report) == reports.REPORT_KEYS and report["schema_version"] == 2
    assert [r["raw_formula"] for r in report["formulas"]] == ["$F I C 1$", "$x$", "$\\neqq$", "$y$", "$$F I C 2$$"] and report["formulas"][0]["bbox"] == [1, 2.5]
    assert set(report["formulas"][0]) == set(reports.RECORD) and set(report["summary"]) == set(reports.SUMMARY_KEYS)
    assert report["summary"] | {} == {"total_formulas": 5, "valid_count": 4, "invalid_syntax_count": 1, "suspicious_count": 3, "issue_formula_count": 4, "scanned_formula_count": 5, "matched_formula_count": 2, "normalization_accepted_count": 1, "normalization_rejected_count": 1}
    assert report["problem_page_indices"] == [2, 3] and len(report["issues"]) == 4


def changed(report, path, value):
    out = json.loads(json.dumps(report))
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    if path[0] == "formulas" and len(path) == 3:  # the issue is the same record
        new = out["formulas"][path[1]]
        out["issues"] = [new if r["formula_id"] == report["formulas"][path[1]]["formula_id"] else r for r in out["issues"]]
    return out


DAMAGES = [
    (("schema_version",), 3, "unknown version"), (("more",), 1, "other members"), (("summary",), KeyError, "other members"), (("validator", "version"), "9", "another validator"), (("summary", "more"), 1, "a summary of other members"), (("summary", "valid_count"), 3, "the summary does not match"),
    (("formulas", 0), 5, "a record that is no object"), (("formulas", 0, "more"), 1, "a record of other members"), (("formulas", 0, "cell_tag"), KeyError, "a record of other members"), (("issues",), [], "the issues are not the formulas with a problem"), (("issues", 0, "raw_formula"), "$z$", "the issues are not the formulas with a problem"),
    (("suspicious_page_indices",), [2], "the page lists do not match"), (("formulas", 0, "formula_id"), "x", "no formula_id"), (("formulas", 0, "raw_formula"), "$z$", "wrong content hash"), (("formulas", 1, "raw_validation_error"), None, "no error with an invalid formula"), (("formulas", 2, "cell_tag"), "p", "a table cell without its place"),
    (("formulas", 0, "is_block"), "yes", "an incomplete place"), (("formulas", 0, "statuses"), ["valid"], "statuses do not match"),
]


def test_reading(spark, report):
    rows = [("good", json.dumps(report)), ("old", json.dumps(legacy(report))), ("text", "{"), ("number", "5"), (None, json.dumps(report))]
    rows += [(f"bad{i}", json.dumps(changed(report, path, value))) for i, (path, value, _) in enumerate(DAMAGES)]
    old = legacy(report)
    rows.append(("old_bad", json.dumps(changed(old, ("formulas", 0, "confidence"), 0.5))))
    got = {r.doc_id: (r.version, r.error) for r in reports.read_reports(spark.createDataFrame(rows, "doc_id string, value string")).collect()}
    assert got["good"] == got[None] == (2, None) and got["old"] == (1, None)
    assert got["text"][1] == "no JSON" and got["number"][1] == "unknown version" and got["old_bad"] == (1, "a repair in a version without repairs")
    assert {i: got[f"bad{i}"][1] for i in range(len(DAMAGES))} == {i: e for i, (*_, e) in enumerate(DAMAGES)}
