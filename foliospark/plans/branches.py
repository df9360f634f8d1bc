"""Queries over what plain inputs don't reach: sources, failing services, damaged reports, odd values, task transitions; with the same results in DuckDB SQL.

Services here fail by rules on the text they get, so that SQL can say what has to come out.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas, markdown, protect, sentences, tables
from ..functions.text import boundary_whitespace, canonical_positive_int, escape_markup, parse_boolean, per_value, truncated
from ..operators import content, formula_audit, render, settings, table_rounds, tasks, translate
from ..session import shared_dir
from ..sources import content as sources
from ..sources import sinks
from ..streaming import changes
from ..streaming import tasks as streams
from . import views
from .registry import query
from .views import BLOCKS_SQL, FORMULA_SQL, LOGS_SQL

_ODD_TAG = re.compile(r"FIC\d*[13579]\}")


def odd_validator(formulas: list[tuple[str, bool]]) -> list[str | None]:
    """Rejects \\neqq as it stands, and repaired tags of an odd number."""
    return ["no such sign" if "\\neqq" in f else "an odd tag" if _ODD_TAG.search(f) else None for f, _ in formulas]


# -- damaged audits


def _damaged(records: DataFrame) -> DataFrame:
    """One damage a record, by item_index modulo 8 (none at 0)."""
    k = F.col("item_index") % 8
    null = F.lit(None).cast("string")
    norm, valid = F.col("normalization_status"), F.col("syntax_status") == "valid"
    seven = k == 7
    return records.withColumns(
        {
            "syntax_status": F.when(k == 1, "odd").otherwise(F.col("syntax_status")),
            "suspicious": F.when(k == 2, ~F.col("suspicious")).otherwise(F.col("suspicious")),
            "statuses": F.when(k == 3, F.array().cast("array<string>")).otherwise(F.col("statuses")),
            "formula_id": F.when(k == 4, "x").otherwise(F.col("formula_id")),
            "field_path": F.when(k == 5, "x").otherwise(F.col("field_path")),
            "raw_validation_error": F.when(k == 6, F.when(valid, F.lit("e"))).otherwise(F.col("raw_validation_error")),
            "normalized_formula": F.when(seven & (norm == "not_applicable"), "z").otherwise(F.col("normalized_formula")),
            "validation_error": F.when(seven & (norm == "accepted"), F.lit("e")).when(seven & (norm == "rejected"), null).otherwise(F.col("validation_error")),
        }
    )


#: Formulas with what odd_validator makes of them: kind 7 is invalid, kinds 2 to 6 are repaired, kind 4 is rejected for odd parts.
AUDIT_SQL = f"""{FORMULA_SQL},
r as (select *, kind = 7 invalid, kind in (2, 3, 4, 5, 7) suspicious, kind = 4 and p::bigint % 2 = 1 rejected, kind in (2, 3, 5, 6) or kind = 4 and p::bigint % 2 = 0 accepted from v5)"""


@query(f"""with {AUDIT_SQL},
bad as (
  select doc_id, case item_index % 8 when 1 then 'unknown syntax status' when 2 then 'suspicious does not match its rules' when 3 then 'statuses do not match' when 4 then 'no formula_id' when 5 then 'an incomplete place'
    when 6 then case when invalid then 'no error with an invalid formula' else 'an error with a valid formula' end
    when 7 then case when accepted then 'an error with an accepted repair' when rejected then 'no error with a rejected repair' else 'a repair that is not applicable' end end error from r),
d as (select distinct doc_id from r)
select doc_id::varchar doc_id, error from bad where error is not null
union all select doc_id::varchar, case when doc_id % 7 = 0 then 'no report' else 'the summary does not match' end from d where doc_id % 7 = 0 or doc_id % 5 = 0
union all select '-1', 'a report without formulas'""")
def q_audit_report_errors(spark, sf):
    rows = formula_audit.audit(formula_audit.scan_items(views.formula_texts(spark, sf)), odd_validator)
    bad = formula_audit.record_errors(_damaged(rows))
    sums = formula_audit.summary(rows)
    odd = sums.filter("doc_id % 7 <> 0").withColumn("total_formulas", F.col("total_formulas") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    more = spark.range(1).select(F.lit(-1).cast("bigint").alias("doc_id"), *(F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in sums.columns if c != "doc_id"))
    found = bad.select(F.col("doc_id").cast("string").alias("doc_id"), "error")
    return found.unionByName(formula_audit.report_errors(rows, odd.unionByName(more)).select(F.col("doc_id").cast("string").alias("doc_id"), "error"))


@query(f"""with {FORMULA_SQL} select doc_id::varchar doc_id, count(*) n, 'formula_id given twice' error from v5, (select unnest([1, 2])) where item_index % 4 = 0 group by 1""")
def q_repeated_formula_ids(spark, sf):
    """Records of every fourth item come twice."""
    records = formula_audit.audit(formula_audit.scan_items(views.formula_texts(spark, sf)))
    found = formula_audit.record_errors(records.unionByName(records.filter("item_index % 4 = 0")))
    return found.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "error").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
select p_partkey id, unnest([{'start_at': 9 + length(n), 'raw': '$x_' || n || '$'}, {'start_at': 30 + 2 * length(n), 'raw': '$z$'}], recursive := true)
from (select p_partkey, p_partkey::varchar n from part)""")
def q_escaped_delimiters(spark, sf):
    """Delimiters behind one backslash are text, those behind two aren't; \\\\( is an escaped backslash and a bracket."""
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit(r"A \$"), n, F.lit(r"\$ b $x_"), n, F.lit(r"$ c \\(q\\) and \\$z$ \(w \[v."))
    rows = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(formulas.formula_spans(text)).alias("s"))
    return rows.select("id", F.col("s.start").alias("start_at"), F.col("s.raw_formula").alias("raw"))


# -- translators that fail


_NUMBERED = re.compile(r"(Row|Cap|Order|Price|Client) (\d+)")


class Moody(translate.UppercaseTranslator):
    """Fails by the numbers in the text. Row n, n mod 5: 0 never answers; 1 drops placeholders unless asked strictly; 2 drops them in whole texts; 3 drops them in whole texts and never answers to a sentence with one; 4 is fine. Tables, n mod 4: 0 never answers; 1 answers to single cells only. Captions, n mod 5 = 0: never."""

    def translate(self, text: str, *, strict: bool = False, response_format: dict | None = None) -> str:
        found = _NUMBERED.search(text)
        if found is None:
            return super().translate(text, strict=strict, response_format=response_format)
        n = int(found[2])
        if response_format is not None:
            if n % 4 == 0 or n % 4 == 1 and len(json.loads(text)["cells"]) > 1:
                raise ValueError("down")
            return super().translate(text, strict=strict, response_format=response_format)
        if n % 5 == 0:
            raise ValueError("down")
        if found[1] == "Row":
            whole = "It costs" in text
            if n % 5 == 1 and not strict or n % 5 in (2, 3) and whole:
                return "nothing of it"
            if n % 5 == 3:
                raise ValueError("down")
        return super().translate(text, strict=strict, response_format=response_format)


def _two_sentences(spark, sf) -> DataFrame:
    """Line items as texts of two sentences, the first with a formula; page and box as there."""
    rows = views.formula_texts(spark, sf)
    p, s = F.regexp_extract("text", r"^Row (\d+)", 1), F.regexp_extract("text", r"costs \$(\d+) now", 1)
    return rows.withColumn("text", F.concat(F.lit("Row "), p, F.lit(": $"), F.col("formula"), F.lit("$ is set. It costs "), s, F.lit(" now."))).drop("formula")


def _orders(spark, sf) -> DataFrame:
    """Orders as tables with a caption and a footnote; some empty, some broken."""
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("n"))
    n, none = F.col("n").cast("string"), F.lit(None)
    html = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in ("<table><tr><td>Order ", n, "</td><td>Price ", n, "</td></tr><tr><td>Client ", n, "</td><td>12.5 to 13</td></tr></table>")))
    body = F.when(F.col("n") % 6 == 0, none).when(F.col("n") % 8 == 2, "<p>").otherwise(html)
    captions = F.when(F.col("n") % 6 != 0, F.array(F.concat(F.lit('"Cap '), n, F.lit('"'))))
    notes = F.when((F.col("n") % 6 != 0) & (F.col("n") % 7 == 0), F.array(F.lit('" "'), F.lit("5")))
    return o.select("doc_id", F.lit(1000).cast("bigint").alias("item_index"), F.lit("table").alias("type"), none.cast("string").alias("text"), F.lit("missing").alias("text_kind"), none.cast("bigint").alias("page_idx"), body.cast("string").alias("table_body"), none.cast("string").alias("img_path"), captions.alias("captions"), notes.alias("footnotes"))


def _outcomes(spark, sf, with_tables: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, auxiliary texts, stored outcomes) of a run with the moody translator."""
    items = _two_sentences(spark, sf)
    if with_tables:
        items = items.unionByName(_orders(spark, sf), allowMissingColumns=True)
    states = translate.new_states(items)
    auxiliary = translate.auxiliary_units(items)
    path = f"{shared_dir(spark)}/foliospark/moody-{uuid.uuid4().hex}"
    translate.run_units(translate.work_units(states, auxiliary), Moody()).write.parquet(path)
    return states, auxiliary, spark.read.parquet(path)


_ROW = "'Row ' || p || ': $' || formula || '$ is set.'"
_LEFT = "'ROW ' || p || ': $' || formula || '$ IS SET.'"
_REST = "' IT COSTS ' || s || ' NOW.'"


@query(f"""with {FORMULA_SQL}
select doc_id::varchar doc_id, item_index, case m when 0 then 'failed' else 'success' end status, case m when 0 then null when 3 then {_ROW} || {_REST} else {_LEFT} || {_REST} end translated,
  case m when 0 then 'down' end error, case m when 0 then 2 when 1 then 2 when 4 then 1 else 4 end model_calls, case m when 1 then 'full_retry' when 2 then 'split_retry' when 3 then 'split_retry' when 4 then 'normal' end as level,
  case m when 1 then 'normal: a placeholder is missing' when 2 then 'normal: a placeholder is missing, full_retry: a placeholder is missing' when 3 then 'normal: a placeholder is missing, full_retry: a placeholder is missing' end diagnostics
from (select *, p::bigint % 5 m from v5)""")
def q_translate_retries(spark, sf):
    states, _, outcomes = _outcomes(spark, sf, False)
    told = F.array_join(F.transform("diagnostics", lambda d: F.concat(d["phase"], F.lit(": "), d["error"])), ", ")
    return outcomes.select("doc_id", "item_index", "status", "translated", "error", "model_calls", "level", told.alias("diagnostics"))


COUNTERS_SQL = f"""{FORMULA_SQL},
t as (
  select doc_id, count(*) n, count(*) filter (p::bigint % 5 <> 0) good, sum(case p::bigint % 5 when 0 then 2 when 1 then 2 when 4 then 1 else 4 end) calls from v5 group by 1),
o as (
  select o_orderkey doc_id, n % 6 = 0 empty, n % 6 <> 0 and n % 8 = 2 broken, n % 4 m, n % 6 <> 0 and n % 5 <> 0 cap, case when n % 6 <> 0 and n % 7 = 0 then 2 else 0 end notes from (select o_orderkey, o_custkey n from orders)),
b as (select *, not empty and not broken fine from o),
k as (
  select doc_id, count(*) tables, count(*) filter (fine) good, count(*) filter (broken) failed, count(*) filter (empty) skipped, count(*) filter (fine and m = 0) partial,
    coalesce(sum(3) filter (fine and m <> 0), 0) cells, coalesce(sum(3) filter (fine and m = 0), 0) fallbacks, coalesce(sum(case when m in (0, 1) then 4 else 1 end) filter (fine), 0) calls,
    count(*) filter (not empty) + sum(notes) aux, count(*) filter (cap) aux_good, count(*) filter (not empty and not cap) + sum(notes) aux_failed, coalesce(sum(case when cap then 1 else 2 end) filter (not empty), 0) aux_calls from b group by 1),
d as (select distinct doc_id from (select doc_id from t union all select doc_id from k)),
c as (
  select d.doc_id::varchar doc_id, coalesce(t.n, 0) text_count, coalesce(t.good, 0) success_count, coalesce(t.n - t.good, 0) failed_count, 0::bigint pending_count, coalesce(tables, 0) table_count, coalesce(k.good, 0) table_success_count, coalesce(k.failed, 0) table_failed_count,
    0::bigint table_pending_count, coalesce(k.skipped, 0) table_skipped_count, coalesce(partial, 0) table_partial_success_count, coalesce(cells, 0)::bigint table_translation_success_cell_count, coalesce(fallbacks, 0)::bigint table_translation_fallback_cell_count,
    (coalesce(t.calls, 0) + coalesce(k.calls, 0) + coalesce(aux_calls, 0))::bigint model_call_count, coalesce(t.calls, 0)::bigint text_model_call_count, coalesce(k.calls, 0)::bigint table_model_call_count, coalesce(aux_calls, 0)::bigint auxiliary_model_call_count,
    coalesce(aux, 0)::bigint auxiliary_count, coalesce(aux_good, 0) auxiliary_success_count, coalesce(aux_failed, 0)::bigint auxiliary_failed_count, 0::bigint auxiliary_pending_count, 0::bigint skipped_success_count, 0::bigint skipped_table_success_count, 0::bigint skipped_auxiliary_success_count
  from d left join t using (doc_id) left join k using (doc_id))"""


def _counters(spark, sf) -> DataFrame:
    states, auxiliary, outcomes = _outcomes(spark, sf, True)
    return translate.translation_stats(translate.apply_outcomes(states, outcomes), outcomes, translate.apply_auxiliary(auxiliary, outcomes))


@query(f"with {COUNTERS_SQL} select * from c")
def q_translation_counters(spark, sf):
    return _counters(spark, sf)


@query(f"""with {COUNTERS_SQL}
select doc_id, 'calls: model_call ' || model_call_count || ', text_model_call ' || text_model_call_count || ', table_model_call ' || table_model_call_count || ', auxiliary_model_call ' || auxiliary_model_call_count || chr(10)
  || 'texts: text ' || text_count || ', success ' || success_count || ', failed ' || failed_count || ', pending ' || pending_count || ', skipped_success ' || skipped_success_count || chr(10)
  || 'tables: table ' || table_count || ', table_success ' || table_success_count || ', table_partial_success ' || table_partial_success_count || ', table_failed ' || table_failed_count || ', table_skipped ' || table_skipped_count || chr(10)
  || 'captions: auxiliary ' || auxiliary_count || ', auxiliary_success ' || auxiliary_success_count || ', auxiliary_failed ' || auxiliary_failed_count || ', auxiliary_pending ' || auxiliary_pending_count as text from c""")
def q_stats_text(spark, sf):
    from .workflow import stats_text

    return stats_text(_counters(spark, sf))


@query(f"""with {COUNTERS_SQL}
select d.doc_id::varchar doc_id, coalesce(t.n, 0) text_count, coalesce(t.n, 0) success_count, 0::bigint failed_count, coalesce(t.good, 0) skipped_success_count, coalesce(t.n - t.good, 0) text_model_call_count,
  coalesce(tables, 0) table_count, coalesce(k.good, 0) table_success_count, coalesce(k.failed, 0) table_failed_count, coalesce(k.skipped, 0) table_skipped_count, coalesce(k.good, 0) skipped_table_success_count, 0::bigint table_model_call_count
from d left join t using (doc_id) left join k using (doc_id)""")
def q_resume_counters(spark, sf):
    """A second run after the moody one, with a translator that answers always: what succeeded is skipped, partial tables too; broken tables fail again without a call."""
    states, _, outcomes = _outcomes(spark, sf, True)
    items = states.drop("translation_status", "translated_text", "translated_table_body", "translation_error")
    again = translate.resume_states(items.withColumn("doc_id", F.col("doc_id").cast("string")), translate.apply_outcomes(states, outcomes))
    path = f"{shared_dir(spark)}/foliospark/resumed-{uuid.uuid4().hex}"
    translate.run_units(translate.work_units(again), translate.UppercaseTranslator()).write.parquet(path)
    second = spark.read.parquet(path)
    stats = translate.translation_stats(translate.apply_outcomes(again, second), second)
    return stats.select(
        "doc_id", "text_count", "success_count", "failed_count", "skipped_success_count", "text_model_call_count",
        "table_count", "table_success_count", "table_failed_count", "table_skipped_count", "skipped_table_success_count", "table_model_call_count",
    )


@query(f"with {FORMULA_SQL} select doc_id::varchar doc_id, item_index from v5 where kind = 7")
def q_left_pending(spark, sf):
    """Outcomes came for all texts but those of one kind."""
    rows = views.formula_texts(spark, sf).withColumn("kind_no", F.regexp_like("text", F.lit(r"neqq x\$")))
    states = translate.new_states(rows.drop("kind_no"))
    null = F.lit(None)
    came = rows.filter(~F.col("kind_no")).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("text").alias("kind"), "item_index", F.lit("success").alias("status"), F.upper("text").alias("translated"),
        null.cast("string").alias("error"), null.cast("int").alias("success_cells"), null.cast("array<struct<cell_id:string,error:string>>").alias("fallbacks"),
    )
    return translate.left_pending(translate.apply_outcomes(states, came))


class Picky(Moody):
    """As Moody; and of tables whose number is 2 modulo 4, the cell with the price never comes back."""

    def translate(self, text: str, *, strict: bool = False, response_format: dict | None = None) -> str:
        answer = super().translate(text, strict=strict, response_format=response_format)
        if response_format is None:
            return answer
        asked = {c["cell_id"]: c["text"] for c in json.loads(text)["cells"]}
        kept = [c for c in json.loads(answer)["cells"] if not re.match(r"Price \d*[02468]$", asked[c["cell_id"]])]
        return json.dumps({"cells": kept}, ensure_ascii=False)


@query(r"""
with o as (select o_orderkey doc_id, n, n % 4 m, n % 6 = 0 empty, n % 6 <> 0 and n % 8 = 2 broken from (select o_orderkey, o_custkey n from orders)),
c as (select *, 'ORDER ' || n a, case when m = 2 then 'Price ' else 'PRICE ' end || n b, 'CLIENT ' || n c from o)
select doc_id::varchar doc_id, case when empty then 'skipped' when broken then 'failed' else 'success' end status,
  case when empty or broken then 0 when m in (0, 1) then 4 when m = 2 then 2 else 1 end model_calls,
  case when not empty and not broken then case m when 0 then 0 when 2 then 2 else 3 end end success_cells,
  case when not empty and not broken then case m when 0 then 'cell-0001: down, cell-0002: down, cell-0003: down' when 2 then 'cell-0002: the answer lacks a cell' else '' end end fallbacks,
  case when not empty and not broken then case m when 0 then '<table><tr><td>Order ' || n || '</td><td>Price ' || n || '</td></tr><tr><td>Client ' || n || '</td><td>12.5 to 13</td></tr></table>'
    else '<table><tr><td>' || a || '</td><td>' || b || '</td></tr><tr><td>' || c || '</td><td>12.5 to 13</td></tr></table>' end end translated
from c""")
def q_table_rounds(spark, sf):
    """Partial tables: a first round of whole tables, a second of the single cells that failed."""
    units = translate.work_units(translate.new_states(_orders(spark, sf)))
    done = table_rounds.run_tables(units, f"{shared_dir(spark)}/foliospark/answers-{uuid.uuid4().hex}", Picky(), flush=500)
    told = F.array_join(F.transform("fallbacks", lambda f: F.concat(f["cell_id"], F.lit(": "), f["error"])), ", ")
    return done.select("doc_id", "status", "model_calls", "success_cells", told.alias("fallbacks"), "translated")


@query("""
select o_orderkey doc_id, 1000::bigint item_index, field, pos, text, case when text is null or text = ' ' then 'failed' else 'pending' end status, case when text is null or text = ' ' then 'an auxiliary text must be a non-blank string' end error
from (select o_orderkey, unnest([{'field': 'table_caption', 'pos': 0, 'text': 'Cap ' || o_custkey}, {'field': 'table_footnote', 'pos': 0, 'text': ' '}, {'field': 'table_footnote', 'pos': 1, 'text': null}], recursive := true), o_custkey from orders where o_custkey % 6 <> 0)
where field = 'table_caption' or o_custkey % 7 = 0""")
def q_auxiliary_units(spark, sf):
    return translate.auxiliary_units(_orders(spark, sf))


# -- sources


def _zip(*members: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def _supplier_archive(row: dict) -> bytes:
    """A content list for even keys; else structured output whose table has its HTML in the middle document if the boxes agree."""
    key, name = row["k"], row["name"]
    if key % 2 == 0:
        return _zip((f"out/{key}_content_list.json", json.dumps([{"type": "text", "text": name, "text_level": 2, "page_idx": 3}, {"type": "table", "table_body": "<table></table>", "table_caption": ["cap", 5]}, 7, {"type": "text", "text": 1, "text_level": True, "page_idx": 1.0}])))
    box = [1, key] if key % 3 else [1, 2, 3]
    structured = {"pages": [{"page_idx": 4, "blocks": [{"type": "paragraph_title", "content": f" {name} ", "level": 1}, {"type": "table", "content": "|a|\n|-|\n|1|", "bbox": [1, key]}]}]}
    middle = {"pages": [{"page_idx": 4, "blocks": []}, {"page_idx": 4, "blocks": [{}, {"type": "table", "bbox": box, "content": [{"type": "table_body", "content": f" <table><tr><td>{key}</td></tr></table> "}]}]}]}
    return _zip(("a/structured_content.json", json.dumps(structured)), ("a/middle_json.json", json.dumps(middle)))


_archive = per_value(_supplier_archive, "binary")


@query("""
select s_suppkey::varchar doc_id, i item_index,
  case when s_suppkey % 2 = 0 then case i when 2 then null when 1 then 'table' else 'text' end else case i when 0 then 'text' else 'table' end end as type,
  case when i = 0 then s_name end as text, case when i = 0 then case when s_suppkey % 2 = 0 then 2 else 1 end end text_level,
  case when s_suppkey % 2 = 0 then case when i = 0 then 3 end else 4 end page_idx,
  case when s_suppkey % 2 = 0 then case when i = 1 then '<table></table>' end when i = 1 and s_suppkey % 3 <> 0 then '<table><tr><td>' || s_suppkey || '</td></tr></table>' when i = 1 then 'pipe' end table_body,
  case when i = 1 and s_suppkey % 2 = 0 then '"cap",5' when i = 1 then '' end captions
from supplier, (select unnest(range(0, 4)) i) where s_suppkey % 2 = 0 or i < 2""")
def q_archive_items(spark, sf):
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), _archive(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))).alias("content"))
    items = sources.archive_items(sources.unzip(s))
    piped = F.col("table_body").isNotNull() & ~F.contains("table_body", F.col("doc_id")) & (F.col("table_body") != "<table></table>")
    body = F.when(F.contains("table_body", F.concat(F.lit("<td>"), F.col("doc_id"), F.lit("</td>"))) | (F.col("table_body") == "<table></table>"), F.col("table_body")).when(F.col("table_body").isNotNull(), "pipe")
    return items.select("doc_id", "item_index", "type", "text", "text_level", "page_idx", body.alias("table_body"), F.array_join("captions", ",").alias("captions"))


def _paths(spark, sf) -> DataFrame:
    """Files of tasks: a list of their own (two for every seventh), and up to two normalized ones."""
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    k = F.col("doc_id")
    each = F.array_compact(F.array(F.lit("a/x_content_list.json"), F.when(k % 7 == 0, "b/y_content_list.json"), F.when(k % 3 > 0, "a/normalized_content_list.json"), F.when(k % 3 > 1, "b/normalized_content_list.json"), F.lit("a/cleaned_content_list.json"), F.lit("z.txt")))
    return c.select("doc_id", F.explode(F.when(k % 11 == 0, F.array(F.lit("z.txt"))).otherwise(each)).alias("path"))


@query("select c_custkey doc_id, case when c_custkey % 11 <> 0 and c_custkey % 7 <> 0 then 'a/x_content_list.json' end path, case when c_custkey % 11 = 0 then 'none' when c_custkey % 7 = 0 then 'several' end error from customer")
def q_original_list(spark, sf):
    return sources.original_list(_paths(spark, sf))


@query("select c_custkey doc_id, case when k = 0 then 'full' when k = 1 then 'resume' else 'ambiguous' end mode, case when k = 1 then 'a/normalized_content_list.json' end path from (select c_custkey, case when c_custkey % 11 = 0 then 0 else c_custkey % 3 end k from customer)")
def q_checkpoint_choice(spark, sf):
    return sources.checkpoint_choice(_paths(spark, sf))


@query("select 'list' source, c_custkey doc_id, 'a/x_content_list.json' path from customer where c_custkey % 2 = 0 union all select 'structured', c_custkey, 'b/structured_content.json' from customer where c_custkey % 2 = 1")
def q_resolve_lists(spark, sf):
    k = F.col("c_custkey")
    each = F.array_compact(F.array(F.when(k % 2 == 0, "a/x_content_list.json"), F.lit("b/structured_content.json"), F.lit("c/middle_json.json")))
    return sources.resolve_lists(views.table(spark, sf, "customer").select(k.alias("doc_id"), F.explode(each).alias("path")))


_UPLOAD = "case c_custkey % 5 when 1 then 'not a .pdf name' when 2 then 'unexpected content type' when 3 then 'too large' when 4 then 'no PDF' end"


def _uploads(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 5 == 4, "PDF").otherwise(F.lit("%PDF-")), (k % 40).cast("string"), F.when(k % 5 == 3, F.repeat(F.lit("x"), F.lit(100))).otherwise(F.lit("")))
    return views.table(spark, sf, "customer").select(k.alias("doc_id"), F.when(k % 5 == 1, "a.txt").otherwise(F.lit("A.PDF")).alias("filename"), F.when(k % 5 == 2, "text/html").otherwise(F.lit("application/pdf")).alias("content_type"), F.to_binary(text, F.lit("utf-8")).alias("content"))


@query(f"select c_custkey doc_id, {_UPLOAD} error from customer")
def q_upload_errors(spark, sf):
    return sources.upload_errors(_uploads(spark, sf), max_bytes=50).select("doc_id", "error")


@query("select min(c_custkey) doc_id from customer group by c_custkey % 40")
def q_distinct_uploads(spark, sf):
    return sources.distinct_uploads(_uploads(spark, sf)).select("doc_id")


# -- content


@query(f"""with {BLOCKS_SQL},
own as (select doc_id, item_index, type, text, page_idx, count(*) over (partition by doc_id) n from v1),
made as (
  select doc_id, item_index previous_index, item_index + case item_index % 5 when 1 then 2 else 1 end next_index from own where item_index % 5 in (0, 1, 3)
  union all select doc_id, item_index, item_index + 1 from own, (select unnest([1, 2])) where item_index % 5 = 2),
joined as (
  select m.*, a.type ta, b.type tb, a.text xa, b.text xb, a.doc_id is null lost_a, b.doc_id is null lost_b,
    count(*) over (partition by m.doc_id, previous_index, next_index) same, count(*) over (partition by m.doc_id, previous_index) ahead, count(*) over (partition by m.doc_id, next_index) behind
  from made m left join own a on a.doc_id = m.doc_id and a.item_index = previous_index left join own b on b.doc_id = m.doc_id and b.item_index = next_index),
told as (
  select doc_id, previous_index, next_index, case when lost_a or lost_b then 'index out of range' when same > 1 then 'repeated candidate' when ahead > 1 then 'two successors' when behind > 1 then 'two predecessors' when next_index <> previous_index + 1 then 'not neighbours'
    when ta <> 'text' or tb <> 'text' then 'no text' when {views.ltrim_sql('xa')} = '' or {views.ltrim_sql('xb')} = '' then 'blank text' end error from joined)
select * from told where error is not null""")
def q_candidate_errors(spark, sf):
    items = views.blocks(spark, sf)
    i = F.col("item_index")
    made = items.filter(i % 5 != 4).select("doc_id", i.alias("previous_index"), F.explode(F.when(i % 5 == 2, F.array(i + 1, i + 1)).when(i % 5 == 1, F.array(i + 2)).otherwise(F.array(i + 1))).alias("next_index"))
    return content.candidate_errors(items, made)


@query(r"""
select s_suppkey::varchar doc_id, '# ' || s_name || chr(10) || chr(10) || 'ref ' || s_suppkey || chr(10) || chr(10) || '$$' || chr(10) || 'x_' || s_suppkey || chr(10) || '$$' || chr(10) || chr(10) || '\[y\]' || chr(10) || chr(10)
  || '![](img/' || s_suppkey || '.png)' || chr(10) || chr(10) || 'cap' || chr(10) || chr(10) || 'note' || chr(10) || chr(10) || 'head' || chr(10) || chr(10) || '<table>' || s_suppkey || '</table>' || chr(10) markdown from supplier""")
def q_render_types(spark, sf):
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").cast("string").alias("k"), "s_name")
    names = ("type", "text", "text_level", "img_path", "table_body", "captions", "footnotes")
    types = ("string", "string", "bigint", "string", "string", "array<string>", "array<string>")

    def item(**given: Column) -> Column:
        return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in zip(names, types, strict=True)))

    json_text = lambda *values: F.array(*(F.lit(v) for v in values))
    made = [
        item(type=F.lit("text"), text=F.col("s_name"), text_level=F.lit(1)), item(type=F.lit("ref_text"), text=F.concat(F.lit("ref "), F.col("k"))), item(type=F.lit("text"), text=F.lit("  ")),
        item(type=F.lit("equation"), text=F.concat(F.lit(" x_"), F.col("k"), F.lit(" "))), item(type=F.lit("equation"), text=F.lit(r"\[y\]")),
        item(type=F.lit("image"), img_path=F.concat(F.lit("img/"), F.col("k"), F.lit(".png")), captions=json_text('"cap"', "5", '" "'), footnotes=json_text('"note"')),
        item(type=F.lit("table"), table_body=F.concat(F.lit("<table>"), F.col("k"), F.lit("</table>")), captions=json_text('"head"')), item(type=F.lit("footer"), text=F.lit("left out")),
    ]
    rows = s.select("doc_id", F.posexplode(F.array(*made)).alias("item_index", "x")).select("doc_id", F.col("item_index").cast("bigint").alias("item_index"), "x.*")
    return render.render(rows)


# -- text, tables, protection


@query(r"""select o_orderkey doc_id, '<table><tr><th>Order key</th><th>Price</th></tr><tr><td rowspan="2">Customer ' || o_custkey || '</td><td>$q$ of <em>' || o_orderpriority || '</em></td></tr><tr><td>12.5 to 13</td></tr><tr><td>AB-12</td><td>\(q\) low &amp; high</td></tr></table>' html from orders""")
def q_replace_table_spans(spark, sf):
    t = views.order_tables(spark, sf)
    number = F.regexp_extract("table_body", r"Customer (\d+)", 1)
    fixed = F.array(F.struct(F.concat(F.lit("$p_{"), number, F.lit("}$")).alias("raw_formula"), F.lit(False).alias("is_block"), F.lit("$q$").alias("normalized")))
    return t.select("doc_id", tables.replace_table_spans(F.col("table_body"), fixed).alias("html"))


@query(f"with {FORMULA_SQL} select doc_id, item_index, '0001' ids from v5")
def q_placeholder_ids(spark, sf):
    rows = views.formula_texts(spark, sf)
    held = rows.withColumn("p", protect.protect("text", protect.nonce_of(F.col("doc_id"), F.col("item_index"))))
    return held.select("doc_id", "item_index", F.array_join(protect.placeholder_ids(F.col("p.model_text")), ",").alias("ids"))


@query(f"""with {FORMULA_SQL}
select doc_id, item_index, case item_index % 5 when 0 then null when 1 then 'a placeholder is missing' when 2 then 'a placeholder is repeated' when 3 then 'a placeholder is damaged' else 'a placeholder is unknown' end error from v5""")
def q_restore_errors(spark, sf):
    """Translations that lose, repeat, damage or invent placeholders."""
    rows = views.formula_texts(spark, sf).withColumn("nonce", protect.nonce_of(F.col("doc_id"), F.col("item_index")))
    held = rows.withColumn("p", protect.protect("text", "nonce"))
    m, k = F.col("p.model_text"), F.col("item_index") % 5
    mark = F.regexp_extract(m, "(⟪[^⟫]*⟫)", 1)
    said = F.when(k == 1, F.lit("nothing")).when(k == 2, F.concat(m, mark)).when(k == 3, F.replace(m, F.lit("⟫"), F.lit(""))).when(k == 4, F.concat(m, F.replace(mark, F.lit(":0001:"), F.lit(":0002:")))).otherwise(m)
    return held.select("doc_id", "item_index", protect.restore(said, F.col("p.formulas"), F.col("nonce"))["error"].alias("error"))


@query("""
select s_suppkey doc_id, 1 + s_suppkey % 40 n_sentences, ceil((1 + s_suppkey % 40) / 15.0)::int n_chunks, 'No. 4.5 of e.g. Dr. X is it ' || s_suppkey || '?' first_of_two, 2 n_of_two from supplier""")
def q_sentences(spark, sf):
    """Sentences of 40 characters, of which 15 fill a chunk of 600; and two with periods that end none."""
    key = F.col("s_suppkey")
    many = F.rtrim(F.repeat(F.lit("It is a sentence of forty signs and so. "), (key % 40 + 1).cast("int")))
    two = sentences.sentences(F.concat(F.lit("No. 4.5 of e.g. Dr. X is it "), key.cast("string"), F.lit("? (Yes!)")))
    made = views.table(spark, sf, "supplier").select(key.alias("doc_id"), F.size(sentences.sentences(many)).alias("n_sentences"), F.size(sentences.chunks(many)).alias("n_chunks"), two.alias("two"))
    return made.select("doc_id", "n_sentences", "n_chunks", F.get("two", F.lit(0)).alias("first_of_two"), F.size("two").alias("n_of_two"))


@query("""
select o_orderkey id, case k when 0 then o_orderkey + 1 end number, case when k = 1 or v = '1' then true when k = 2 then false end flag, '[' || case k when 3 then ' ' else '' end || '|' || v || '|' || case k when 3 then chr(10) else '' end || ']' parts, left(v, 3) short, replace(v, '<', '&lt;') escaped
from (select o_orderkey, o_orderkey % 6 k, case o_orderkey % 6 when 0 then (o_orderkey + 1)::varchar when 1 then 'Yes' when 2 then 'OFF' when 3 then 'a<b' when 4 then '0' || o_orderkey || 'x' else '-1.5' end v from orders)""")
def q_setting_values(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    k = F.col("id") % 6
    text = F.when(k == 0, (F.col("id") + 1).cast("string")).when(k == 1, "Yes").when(k == 2, "OFF").when(k == 3, " a<b\n").when(k == 4, F.concat(F.lit("0"), F.col("id").cast("string"), F.lit("x"))).otherwise(F.lit("-1.5"))
    b = boundary_whitespace(text)
    parts = F.concat(F.lit("["), b["lead"], F.lit("|"), b["body"], F.lit("|"), b["trail"], F.lit("]"))
    return o.select("id", canonical_positive_int(text).alias("number"), parse_boolean(text).alias("flag"), parts.alias("parts"), truncated(b["body"], 3).alias("short"), escape_markup(b["body"]).alias("escaped"))


@query("""
select page_id, case page_id % 6 when 0 then 'https://h/x' when 1 then '/assets/a/' || page_id when 4 then '/assets/b%20c' end url from pages""")
def q_safe_url(spark, sf):
    k = F.col("page_id") % 6
    url = F.when(k == 0, "https://h/x").when(k == 1, F.concat(F.lit("./a/"), F.col("page_id").cast("string"))).when(k == 2, "javascript:x").when(k == 3, "../up").when(k == 4, "b c").otherwise(F.lit("/root"))
    checked = per_value(lambda u: markdown.safe_url(u, "/assets"), "string")
    return views.table(spark, sf, "pages").select("page_id", checked(url).alias("url"))


@query("""
select s_suppkey id, case s_suppkey % 6 when 1 then 'not http or https' when 2 then 'no host' when 3 then 'credentials' when 4 then 'a query or fragment' when 5 then 'port out of range' end error from supplier""")
def q_connection_errors(spark, sf):
    k = F.col("s_suppkey") % 6
    url = F.when(k == 1, "ftp://h").when(k == 2, "http://").when(k == 3, "http://u:p@h").when(k == 4, "http://h?x").when(k == 5, "http://h:99999").otherwise(F.concat(F.lit("http://h:80/"), F.col("s_suppkey").cast("string")))
    return views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), settings.connection_error(url).alias("error"))


# -- settings and endpoints


@query("""
select 'key' || c_custkey as key, case when c_custkey % 5 = 0 then 'new' when c_custkey % 3 = 0 then 'own' else 'default' end as value from customer
union all select 'api_key', 'true'""")
def q_settings_overlay(spark, sf):
    """Defaults, overlaid by stored values (null: the default), then by changes; a blank secret keeps what there is, and is only shown to be there."""
    k = views.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("key"), F.col("c_custkey").cast("string")).alias("key"))
    secret = lambda v: spark.range(1).select(F.lit("api_key").alias("key"), F.lit(v).alias("value"))
    defaults = k.select("key", F.lit("default").alias("value")).unionByName(secret("s"))
    stored = k.filter("c_custkey % 3 in (0, 1)").select("key", F.when(F.col("c_custkey") % 3 == 0, "own").alias("value"))
    changes = k.filter("c_custkey % 5 = 0").select("key", F.lit("new").alias("value")).unionByName(secret(" "))
    return settings.public(settings.save(settings.overlay(defaults, stored), changes))


@query("select min(s_suppkey) id, 'http://h' || min(s_suppkey) endpoint from supplier where s_nationkey % 3 = 1 and s_suppkey % 2 = 1")
def q_choose_endpoint(spark, sf):
    """Instances by nation; no running one has the route's own name, so its targets count."""
    s = views.table(spark, sf, "supplier")
    model = F.concat(F.lit("m"), (F.col("s_nationkey") % 3).cast("string"))
    instances = s.select(F.col("s_suppkey").alias("id"), model.alias("model_id"), F.concat(F.lit("http://h"), F.col("s_suppkey").cast("string")).alias("endpoint"), F.when(F.col("s_suppkey") % 2 == 1, "running").otherwise(F.lit("stopped")).alias("state"))
    routes = spark.range(1).select(F.lit("route").alias("name"), F.lit("m1").alias("target_model_id"))
    return settings.choose_endpoint(instances, routes, "route")


# -- tasks


def _task_rows(spark, sf) -> DataFrame:
    logs = views.task_logs(spark, sf)
    null = F.lit(None)
    rows = logs.groupBy(F.col("task_id").alias("id")).agg(F.max_by("status", "id").alias("status"), F.min("created_at").alias("created_at"), F.count(F.lit(1)).cast("int").alias("attempt_count"))
    return rows.select("id", "status", "attempt_count", F.lit("old").alias("error_message"), "created_at", F.col("created_at").alias("updated_at"), null.cast("timestamp").alias("started_at"), null.cast("timestamp").alias("finished_at"), null.cast("string").alias("normalized_path"), null.cast("string").alias("markdown_path"))


_TASKS = f"{LOGS_SQL}, t as (select task_id id, max_by(status, id) status, min(created_at) created_at, count(*)::int attempt_count from v4 group by 1)"
_NOW = "2030-01-01 00:00:00"


@query(f"with {_TASKS}, f as (select id from t where status = 'queued' order by created_at, id limit 1) select t.id, case when f.id is not null then 'running' else status end status, attempt_count + case when f.id is not null then 1 else 0 end attempt_count, f.id is not null started from t left join f using (id)")
def q_task_claim(spark, sf):
    claimed, _ = tasks.claim_next(_task_rows(spark, sf), F.lit(_NOW).cast("timestamp"))
    return claimed.select("id", "status", "attempt_count", F.col("started_at").isNotNull().alias("started"))


@query(f"with {_TASKS} select id, case when status = 'running' then 'interrupted' else status end status, case when status = 'running' then '{tasks.INTERRUPTED_MESSAGE}' else 'old' end error_message, status = 'running' finished from t")
def q_task_interrupt(spark, sf):
    return tasks.interrupt_running(_task_rows(spark, sf), F.lit(_NOW).cast("timestamp")).select("id", "status", "error_message", F.col("finished_at").isNotNull().alias("finished"))


@query(f"with {LOGS_SQL} select id, task_id, 'A LEVEL OF MORE ' as level, message from v4 union all select -id, task_id, 'A LEVEL OF MORE ', 'more' from v4 where id % 2 = 0")
def q_append_logs(spark, sf):
    """New rows of tasks that exist and of tasks that don't."""
    logs = views.task_logs(spark, sf).select("id", "task_id", F.lit("A LEVEL OF MORE ").alias("level"), "message", "created_at")
    new = logs.select((-F.col("id")).alias("id"), F.when(F.col("id") % 2 == 0, F.col("task_id")).otherwise(F.concat(F.lit("none"), F.col("task_id"))).alias("task_id"), F.lit("A LEVEL OF MORE THAN SIXTEEN").alias("level"), F.lit("more").alias("message"), "created_at")
    return tasks.append_logs(logs, new, _task_rows(spark, sf)).select("id", "task_id", "level", "message")


@query(f"with {_TASKS} select id, id j_id, status, strftime(created_at + interval 8 hour, '%Y-%m-%d %H:%M:%S') shown, true named from t")
def q_task_json(spark, sf):
    made = tasks.task_json(_task_rows(spark, sf))
    at = lambda name: F.get_json_object("json", f"$.{name}")
    return made.select("id", at("id").alias("j_id"), at("status").alias("status"), at("created_at_display").alias("shown"), F.contains("json", F.lit('"finished_at":null')).alias("named"))


# -- streams


@query("select user_id::varchar task_id, max_by(event_type, event_id) status, max(event_id) last_id from events group by 1 order by last_id desc limit 100")
def q_stream_snapshots(spark, sf):
    """The newest 100 task states, as a snapshot stream sends and stores them last."""
    from .catalogue import _event_stream

    rows = _event_stream(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("status"))
    checkpoint = f"{shared_dir(spark)}/foliospark/snapshots-{uuid.uuid4().hex}"
    streams.snapshots(rows, checkpoint, lambda _: None).awaitTermination()
    return sinks.read_stage(spark, f"{checkpoint}.newest")


def _logs(spark, sf) -> DataFrame:
    return views.task_logs(spark, sf).select("id", "task_id", "level", "message", F.col("created_at").cast("timestamp").alias("created_at"))


def _logs_back(rows: DataFrame) -> DataFrame:
    return rows.select("id", "task_id", "level", "message", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"with {LOGS_SQL} select id, task_id, level, message, created_at from v4 where id > 100")
def q_log_pages(spark, sf):
    """Pages of 500 after a cursor, by a query that stops after each of two parts of the table and goes on from its checkpoint."""
    base = f"{shared_dir(spark)}/foliospark/pages-{uuid.uuid4().hex}"
    logs = _logs(spark, sf)
    half = logs.agg((F.max("id") / 2).cast("bigint")).first()[0]
    for part in (logs.filter(F.col("id") <= half), logs.filter(F.col("id") > half)):
        # small row groups, as a page decodes those it lies in
        part.repartitionByRange(4, "id").write.mode("append").option("parquet.block.size", 8 << 20).parquet(f"{base}/logs")
        query = streams.tail_pages(streams.log_pages(spark, f"{base}/logs", last_event_id="100", after_id=7), f"{base}/checkpoint", f"{base}/rows")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return _logs_back(spark.read.parquet(f"{base}/rows"))


@query(f"with {LOGS_SQL} select id, task_id, level, message, created_at from v4")
def q_stream_new_ids(spark, sf):
    """Every third id comes again in a later file."""
    base = f"{shared_dir(spark)}/foliospark/repeats-{uuid.uuid4().hex}"
    logs = _logs(spark, sf)
    logs.repartitionByRange(4, "id").write.parquet(f"{base}/logs")
    logs.filter("id % 3 = 0").repartition(2).write.mode("append").parquet(f"{base}/logs")
    stream = streams.log_stream(spark, f"{base}/logs", logs.schema, 2)
    writer = streams.drop_seen(stream, "3650 days").writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _logs_back(spark.read.parquet(f"{base}/rows"))


@query(f"""with {LOGS_SQL}, e as (select task_id, status, id, lag(status) over (partition by task_id order by id) before from v4)
select task_id, 'change' kind, status, id last_id from e where before is distinct from status""")
def q_stream_changes(spark, sf):
    """What changed of each task, in order; events that leave its state as it was are suppressed, and so are ids that come again."""
    base = f"{shared_dir(spark)}/foliospark/changes-{uuid.uuid4().hex}"
    events = views.task_logs(spark, sf).select("task_id", "id", "status")
    bounds = [r[0] for r in events.agg(F.expr("percentile_approx(id, array(0.3, 0.7))")).collect()][0]
    for low, high in ((-1, bounds[0]), (bounds[0] // 2, bounds[1]), (bounds[1], 1 << 62)):
        events.filter(F.col("id").between(low + 1, high)).coalesce(1).write.mode("append").parquet(f"{base}/events")
        stream = streams.log_stream(spark, f"{base}/events", events.schema, 1)
        writer = changes.changes(stream, keepalive_s=None).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
        writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/rows/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").drop("batch")
