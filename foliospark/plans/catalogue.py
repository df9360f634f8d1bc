"""The queries of the engine and the same results in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas, markdown, protect, sentences, tables
from ..functions.text import beijing_time, estimate_tokens
from ..operators import content, formula_audit, render, tasks, translate
from ..session import shared_dir, spread
from ..sources import content as sources
from ..streaming import tasks as streams
from . import branches, views
from .registry import QUERIES, SQL, query  # noqa: F401  the lists that the entry reads
from .views import BLOCKS_SQL, CLEAN_SQL, EDGES_SQL, FORMULA_SQL, LOGS_SQL, ltrim_sql, rtrim_sql

# -- content


@query(f"with {CLEAN_SQL} select doc_id, idx item_index, item_index source_index, type, text from clean")
def q_clean_rows(spark, sf):
    return content.clean(views.blocks(spark, sf)).select("doc_id", "item_index", "source_index", "type", "text")


@query(f"""with {BLOCKS_SQL}
select doc_id, count(*) n_before, count(*) filter (gone) n_filtered, count(*) filter (not gone) n_after
from (select doc_id, type = 'header' or (type = 'text' and {ltrim_sql('text')} = '') gone from v1) group by 1""")
def q_clean_counts(spark, sf):
    return content.cleaning_counts(views.blocks(spark, sf)).withColumnsRenamed({"before": "n_before", "filtered": "n_filtered", "after": "n_after"})


def _stats(facet: str, value: str, where: str = "true") -> str:
    return f"with {BLOCKS_SQL} select doc_id, '{facet}' facet, {value}::varchar as value, count(*) n from v1 where {where} group by 1, 3"


@query(_stats("type", "type"))
def q_clean_stats_type(spark, sf):
    return content.statistics(views.blocks(spark, sf)).filter("facet = 'type'")


@query(_stats("page", "page_idx"))
def q_clean_stats_page(spark, sf):
    return content.statistics(views.blocks(spark, sf)).filter("facet = 'page'")


@query(_stats("level", "text_level", "type = 'text' and text_level is not null"))
def q_clean_stats_level(spark, sf):
    return content.statistics(views.blocks(spark, sf)).filter("facet = 'level'")


@query(f"""with {EDGES_SQL}
select doc_id, idx previous_index, idx + 1 next_index, page_idx previous_page_idx, next_page next_page_idx, text previous_text, next_text from edge where joins""")
def q_cross_page_candidates(spark, sf):
    return content.cross_page_candidates(content.clean(views.blocks(spark, sf))).drop("reason")


@query("select c_custkey doc_id, c_custkey % 9 in (0, 8) joined from customer")
def q_cross_page_negative(spark, sf):
    """Two items of each customer that look like one paragraph (0; 8 ends in a comma), or miss one condition each: 1 ends a sentence, 2 and 3 aren't on consecutive pages, 4 is no text, 5 and 6 have a level, 7 is blank."""
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 9).alias("k"))
    k, first, second = F.col("k"), F.col("item_index") == 0, F.col("item_index") == 1
    text = F.when(first & (k == 1), F.concat("name", F.lit(" ends. "))).when(first & (k == 8), F.concat("name", F.lit(" goes on, "))).when(second & (k == 7), " \n").otherwise(F.concat("name", F.lit(" goes")))
    items = c.withColumn("item_index", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "doc_id", "item_index", F.when(second & (k == 4), "list").otherwise("text").alias("type"), text.alias("text"),
        ((first & (k == 5)) | (second & (k == 6))).alias("has_text_level"), F.when(first, 3).when(k == 2, 3).when(k == 3, 5).otherwise(4).alias("page_idx"),
    )
    found = content.cross_page_candidates(items).select("doc_id", F.lit(True).alias("found"))
    return c.join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("joined"))


@query(f"with {EDGES_SQL} select doc_id, chain, count(*) length from chained group by 1, 2")
def q_chain_lengths(spark, sf):
    return content.chains(content.clean(views.blocks(spark, sf))).groupBy("doc_id", "chain").agg(F.count(F.lit(1)).alias("length"))


@query(f"""with {EDGES_SQL},
numbered as (select *, row_number() over (partition by doc_id, chain order by idx) k, count(*) over (partition by doc_id, chain) n from chained),
trimmed as (select *, case when k > 1 then {ltrim_sql('text')} else text end a from numbered),
pieces as (select *, case when k < n then {rtrim_sql('a')} else a end piece from trimmed),
folded as (select doc_id, chain, string_agg(piece, ' ' order by k) as text, max(n) n, first(type order by k) as type, list(page_idx order by k) pages from pieces group by 1, 2)
select doc_id, row_number() over (partition by doc_id order by chain) - 1 item_index, type, text, case when n > 1 then array_to_string(pages, ',') end pages, n > 1 merged_cross_page from folded""")
def q_normalized_merge(spark, sf):
    merged = content.merge_cross_pages(content.clean(views.blocks(spark, sf)))
    return merged.select("doc_id", "item_index", "type", "text", F.array_join(F.col("source_page_indices").cast("array<string>"), ",").alias("pages"), "merged_cross_page")


@query(f"""with {CLEAN_SQL}
select doc_id, idx item_index, case when type = 'text' then sum(case when type = 'text' then 1 else 0 end) over (partition by doc_id order by idx) end::bigint section_number from clean""")
def q_section_numbers(spark, sf):
    return content.section_numbers(content.clean(views.blocks(spark, sf))).select("doc_id", "item_index", "section_number")


@query(f"""with {BLOCKS_SQL},
altered as (
  select doc_id, item_index, case when item_index % 29 = 3 then text || '!' else text end as text, type,
    case when type in ('text', 'table') then case when item_index % 7 = 1 then 'success' when item_index % 7 = 2 then 'odd' else 'pending' end end status from v1 where item_index % 31 <> 5)
select v.doc_id, v.item_index,
  case when a.doc_id is null then 'the number of items differs' when a.text <> v.text then 'the identity differs' when a.status = 'odd' then 'unknown status' else 'success without a translation' end error
from v1 v left join altered a on a.doc_id = v.doc_id and a.item_index = v.item_index
where a.doc_id is null or a.text <> v.text or a.status in ('odd', 'success')""")
def q_resume_violations(spark, sf):
    now = views.blocks(spark, sf)
    i = F.col("item_index")
    status = F.when(F.col("type").isin("text", "table"), F.when(i % 7 == 1, "success").when(i % 7 == 2, "odd").otherwise("pending"))
    null = F.lit(None).cast("string")
    stored = now.filter(i % 31 != 5).withColumns({"text": F.when(i % 29 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "translation_status": status, "translated_text": null, "translated_table_body": null, "translation_error": null})
    return translate.resume_errors(now, stored)


# -- text functions


@query(f"""with {BLOCKS_SQL}
select doc_id, item_index, greatest(1, (length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 3) // 4 + length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::bigint tokens from v1""")
def q_token_estimate(spark, sf):
    return views.blocks(spark, sf).select("doc_id", "item_index", estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query(f"with {FORMULA_SQL} select doc_id, item_index, sha256('$' || formula || '$') content_hash from v5")
def q_content_hash(spark, sf):
    rows = formula_audit.scan_items(views.formula_texts(spark, sf))
    return rows.select("doc_id", "item_index", "content_hash")


@query()
def q_sentence_split_counts(spark, sf):
    rows = spread(views.table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size(sentences.sentences("text")).alias("n_sentences"), F.size(sentences.chunks("text")).alias("n_chunks"))


@query("select event_id id, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M:%S') shown from events")
def q_beijing_time(spark, sf):
    return views.table(spark, sf, "events").select(F.col("event_id").alias("id"), beijing_time(F.col("ts")).alias("shown"))


# -- formulas


@query(f"""with {FORMULA_SQL},
eq as (select doc_id, item_index, case item_index % 3 when 0 then formula when 1 then ' $$' || formula || '$$ ' else '\\[' || formula || '\\]' end raw, item_index % 3 form, formula from v5)
select doc_id, item_index, raw raw_formula, formula katex_formula, case form when 0 then 0 when 1 then 3 else 2 end katex_start, (case form when 0 then 0 when 1 then 3 else 2 end + length(formula))::int katex_end from eq""")
def q_equation_span(spark, sf):
    i = F.col("item_index") % 3
    raw = F.when(i == 0, F.col("formula")).when(i == 1, F.concat(F.lit(" $$"), F.col("formula"), F.lit("$$ "))).otherwise(F.concat(F.lit("\\["), F.col("formula"), F.lit("\\]")))
    rows = views.formula_texts(spark, sf).withColumn("raw", raw).withColumn("s", formulas.equation_span(F.col("raw")))
    return rows.select("doc_id", "item_index", "s.raw_formula", "s.katex_formula", "s.katex_start", "s.katex_end")


@query(f"""with {FORMULA_SQL}
select doc_id, item_index, '$' || formula || '$' raw_formula, formula katex_formula, (7 - 1 + length(p))::int start_at, (7 - 1 + length(p) + 2 + length(formula))::int end_at from v5""")
def q_formula_spans(spark, sf):
    rows = views.formula_texts(spark, sf).select("doc_id", "item_index", F.explode(formulas.formula_spans("text")).alias("s"))
    return rows.select("doc_id", "item_index", "s.raw_formula", "s.katex_formula", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query()
def q_formula_spans_noise(spark, sf):
    rows = spread(views.table(spark, sf, "documents").select("doc_id", "text").filter(F.contains("text", F.lit("$")) | F.contains("text", F.lit("\\"))))
    return rows.select("doc_id", F.explode(formulas.formula_spans("text")).alias("s")).select("doc_id", "s.start", "s.end", "s.is_block", "s.raw_formula")


@query(f"""with {FORMULA_SQL},
m as (
  select doc_id, item_index, 'mineru_neqq' as rule, unnest(regexp_extract_all(formula, '\\\\neqq')) matched_text from v5
  union all select doc_id, item_index, 'mineru_complement', unnest(regexp_extract_all(formula, '\\\\complement')) from v5
  union all select doc_id, item_index, 'split_instrument_tag', unnest(regexp_extract_all(formula, '[FH]\\s+I\\s+C')) from v5
  union all select doc_id, item_index, 'split_cubic_meter_fraction', unnest(regexp_extract_all(formula, '\\\\frac\\s*\\{{\\s*m\\s+3\\s*\\}}\\s*\\{{\\s*h\\s*\\}}')) from v5)
select * from m""")
def q_suspicious(spark, sf):
    rows = views.formula_texts(spark, sf).select("doc_id", "item_index", F.explode(formulas.suspicions(F.col("formula"))).alias("m"))
    return rows.select("doc_id", "item_index", "m.rule", "m.matched_text")


_REPAIRED = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(formula,
  '\\complement\s*_\s*\{\s*(\d+)\s*\}', '\\mathrm{C}_{\1}', 'g'),
  '(\^\s*\{\s*\\circ\s*\})\s*\\complement', '\1 \\mathrm{C}', 'g'),
  '\\text\s*\{\s*S\s+e\s+t\s+P\s+o\s+i\s+n\s+t\s*\}', '\\mathrm{SetPoint}', 'g'),
  'O\s+u\s+t\s+p\s+u\s+t', '\\mathrm{Output}', 'g'),
  'F\s+I\s+C\s+(\d+)', '\\mathrm{FIC\1}', 'g'),
  '\\frac\s*\{\s*m\s+3\s*\}\s*\{\s*h\s*\}', '\\frac{\\mathrm{m}^{3}}{\\mathrm{h}}', 'g')"""
_RULE = "case kind when 2 then 'mineru_complement_subscript_c' when 3 then 'mineru_degree_complement_c' when 4 then 'numbered_instrument_tag' when 5 then 'cubic_metre_per_hour' when 6 then 'fixed_process_control_field' else '' end"


@query(f"with {FORMULA_SQL} select doc_id, item_index, {_REPAIRED} normalized_formula, {_RULE} rules from v5")
def q_repair(spark, sf):
    rows = formulas.repair(views.formula_texts(spark, sf).select("doc_id", "item_index", "formula"), "formula")
    return rows.select("doc_id", "item_index", "normalized_formula", F.array_join("normalization_rules", ",").alias("rules"))


def _audited(spark, sf):
    return formula_audit.audit(formula_audit.scan_items(views.formula_texts(spark, sf)), branches.odd_validator)


_AUDIT_SQL = f"""{branches.AUDIT_SQL},
a as (select *, {_REPAIRED} fixed from r)"""


@query(f"""with {_AUDIT_SQL}
select doc_id, count(*) total_formulas, count(*) filter (not invalid) valid_count, count(*) filter (invalid) invalid_syntax_count, count(*) filter (suspicious) suspicious_count,
  count(*) filter (suspicious or accepted or rejected) issue_formula_count, count(*) filter (accepted or rejected) matched_formula_count, count(*) filter (accepted) normalization_accepted_count, count(*) filter (rejected) normalization_rejected_count from a group by 1""")
def q_audit_summary(spark, sf):
    drop = ("scanned_formula_count", "problem_page_indices", "invalid_syntax_page_indices", "suspicious_page_indices")
    return formula_audit.summary(_audited(spark, sf)).drop(*drop)


@query(f"""with {_AUDIT_SQL}
select doc_id, coalesce(array_to_string(list_sort(list(distinct page_idx) filter (suspicious or accepted or rejected)), ','), '') problem_pages,
  coalesce(array_to_string(list_sort(list(distinct page_idx) filter (suspicious)), ','), '') suspicious_pages, coalesce(array_to_string(list_sort(list(distinct page_idx) filter (invalid)), ','), '') invalid_pages from a group by 1""")
def q_audit_pages(spark, sf):
    pages = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return formula_audit.summary(_audited(spark, sf)).select("doc_id", pages("problem_page_indices").alias("problem_pages"), pages("suspicious_page_indices").alias("suspicious_pages"), pages("invalid_syntax_page_indices").alias("invalid_pages"))


@query(f"with {_AUDIT_SQL} select distinct doc_id, '$' || formula || '$' raw_formula, false is_block, '$' || fixed || '$' normalized from a where accepted")
def q_accepted_replacements(spark, sf):
    return formula_audit.accepted_replacements(_audited(spark, sf))


@query(f"with {_AUDIT_SQL} select doc_id, item_index, 'Row ' || p || ': $' || case when accepted then fixed else formula end || '$ costs $' || s || ' now.' as text from a")
def q_replace_spans(spark, sf):
    items = views.formula_texts(spark, sf)
    return formula_audit.replace_in_items(items, formula_audit.audit(formula_audit.scan_items(items), branches.odd_validator)).select("doc_id", "item_index", "text")


@query(f"with {_AUDIT_SQL} select doc_id, item_index, '$$' || case when accepted then fixed else formula end || '$$' as text from a")
def q_replace_equations(spark, sf):
    """Equations, each of them one block formula, replaced by their content."""
    items = views.formula_texts(spark, sf).withColumns({"type": F.lit("equation"), "text": F.concat(F.lit("$$"), F.col("formula"), F.lit("$$"))})
    records = formula_audit.audit(formula_audit.scan_items(items), branches.odd_validator)
    lists = formula_audit.replacement_lists(formula_audit.accepted_replacements(records))
    return items.join(lists, "doc_id", "left").select("doc_id", "item_index", formulas.replace_equation(F.col("text"), F.col("replacements")).alias("text"))


# -- tables


@query(r"""
select o_orderkey doc_id, 1 row_idx, 1 col_idx, 'td' cell_tag, 0 formula_index, '$p_{' || o_custkey || '}$' raw_formula from orders
union all select o_orderkey, 3, 1, 'td', 0, '\(q\)' from orders""")
def q_table_grid(spark, sf):
    rows = views.order_tables(spark, sf).select("doc_id", F.explode(tables.table_formulas("table_body")["formulas"]).alias("f"))
    return rows.select("doc_id", "f.row_idx", "f.col_idx", "f.cell_tag", "f.formula_index", "f.span.raw_formula")


def _work(spark, sf):
    rows = views.order_tables(spark, sf).select("doc_id", F.posexplode(tables.table_work("table_body")["items"]).alias("position", "w")).select("doc_id", "position", "w.*")
    return rows.withColumn("estimated_tokens", tables.ITEM_TOKENS + estimate_tokens(F.col("work_id")) + estimate_tokens(F.col("model_text")))


_WORK_SQL = """
w as (
  select o_orderkey doc_id, unnest([
    {'position': 0, 'work_id': 'cell-0001', 'model_text': 'Order key', 'formula_count': 0}, {'position': 1, 'work_id': 'cell-0002', 'model_text': 'Price', 'formula_count': 0},
    {'position': 2, 'work_id': 'cell-0003', 'model_text': 'Customer ' || o_custkey, 'formula_count': 0},
    {'position': 3, 'work_id': 'cell-0004', 'model_text': '⟦M0⟧ of ⟦H0⟧' || o_orderpriority || '⟦H1⟧', 'formula_count': 1},
    {'position': 4, 'work_id': 'cell-0007', 'model_text': '⟦M0⟧ low ⟦H0⟧ high', 'formula_count': 1}], recursive := true) from orders),
e as (select *, 12 + (9 + 3) // 4 + greatest(1, (length(regexp_replace(model_text, '[^\\x00-\\x7F]', '', 'g')) + 3) // 4 + length(model_text) - length(regexp_replace(model_text, '[^\\x00-\\x7F]', '', 'g'))) estimated_tokens from w)"""


@query(f"with {_WORK_SQL} select doc_id, position, work_id, model_text, formula_count, estimated_tokens from e")
def q_cell_work_items(spark, sf):
    return _work(spark, sf).select("doc_id", "position", "work_id", "model_text", "formula_count", "estimated_tokens")


@query(f"""with recursive {BLOCKS_SQL},
t as (select doc_id, item_index i, 12 + greatest(1, (length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 3) // 4 + length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) tok from v1),
r as (
  select doc_id, i, 0 batch, 1 n, 80 + tok total from t where i = 0
  union all
  select t.doc_id, t.i, case when r.n + 1 > 12 or r.total + t.tok > 2000 then r.batch + 1 else r.batch end, case when r.n + 1 > 12 or r.total + t.tok > 2000 then 1 else r.n + 1 end, case when r.n + 1 > 12 or r.total + t.tok > 2000 then 80 + t.tok else r.total + t.tok end
  from r join t on t.doc_id = r.doc_id and t.i = r.i + 1)
select doc_id, i item_index, batch batch_no from r""")
def q_batch_plan(spark, sf):
    items = views.blocks(spark, sf).select("doc_id", F.col("item_index").alias("position"), (tables.ITEM_TOKENS + estimate_tokens(F.col("text"))).alias("estimated_tokens"), F.lit(0).alias("formula_count"))
    return translate.plan_batches(items, ["doc_id"]).select("doc_id", F.col("position").alias("item_index"), "batch_no")


@query(f"with {FORMULA_SQL} select doc_id, item_index, text, 1 formulas from v5t")
def q_protect_restore_roundtrip(spark, sf):
    rows = views.formula_texts(spark, sf).withColumn("nonce", protect.nonce_of(F.col("doc_id"), F.col("item_index"))).withColumn("p", protect.protect("text", "nonce"))
    back = rows.withColumn("r", protect.restore("p.model_text", "p.formulas", "nonce"))
    return back.select("doc_id", "item_index", F.col("r.text").alias("text"), F.size("p.formulas").alias("formulas"))


# -- structured output


@query("""
select s_suppkey doc_id, i item_index, case i when 0 then 'text' when 1 then 'table' when 2 then 'image' else 'footer' end as type, case i when 0 then s_name when 3 then 'end' end as text,
  case when i = 0 then 2 end text_level, case when i < 3 then 7 else 1 end page_idx, case when i = 2 then 'img/' || s_suppkey || '.png' end img_path, case when i = 1 then 'cap' end caption, i = 1 has_table
from supplier, (select unnest(range(0, 4)) i)""")
def q_structured_flatten(spark, sf):
    s = views.table(spark, sf, "supplier")
    title = F.struct(F.lit("paragraph_title").alias("type"), F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")).alias("content"), F.lit(2).alias("level"))
    parts = [
        F.lit('{"pages":[{"page_idx":7,"blocks":['), F.to_json(title), F.lit(',{"type":"table","content":"|a|b|\\n|-|-|\\n|1|2|","bbox":[1,2],"captions":[{"content":" cap "},{"content":" "}]},{"type":"image","image_source":" img/'),
        F.col("s_suppkey").cast("string"), F.lit('.png "},5]},{"page_idx":true,"blocks":[{"type":"footer","content":" end "}]},"x"]}'),
    ]
    items = sources.structured_items(s.select(F.col("s_suppkey").alias("doc_id"), F.concat(*parts).alias("value")))
    return items.select("doc_id", "item_index", "type", "text", "text_level", "page_idx", "img_path", F.get("captions", F.lit(0)).alias("caption"), F.coalesce(F.startswith("table_body", F.lit("<table>")), F.lit(False)).alias("has_table"))


# -- translation and rendering


def _translated(spark, sf):
    """States, and the outcomes of a first run: written, so that nothing is translated twice."""
    states = translate.new_states(views.formula_texts(spark, sf))
    path = f"{shared_dir(spark)}/foliospark/outcomes-{uuid.uuid4().hex}"
    translate.run_units(translate.work_units(states), translate.UppercaseTranslator()).write.parquet(path)
    return states, spark.read.parquet(path)


@query(f"with {FORMULA_SQL} select doc_id::varchar doc_id, item_index, 'success' translation_status, 'ROW ' || p || ': $' || formula || '$ COSTS $' || s || ' NOW.' translated_text from v5")
def q_translate_states(spark, sf):
    return translate.apply_outcomes(*_translated(spark, sf)).select("doc_id", "item_index", "translation_status", "translated_text")


@query(f"with {FORMULA_SQL} select doc_id::varchar doc_id, count(*) text_count, count(*) success_count, 0::bigint failed_count, 0::bigint pending_count, count(*) model_call_count, 0::bigint skipped_success_count from v5 group by 1")
def q_translation_stats(spark, sf):
    states, outcomes = _translated(spark, sf)
    stats = translate.translation_stats(translate.apply_outcomes(states, outcomes), outcomes)
    return stats.select("doc_id", "text_count", "success_count", "failed_count", "pending_count", "model_call_count", "skipped_success_count")


@query("""select o_orderkey::varchar doc_id, 'success' status, 1 model_calls, 5 success_cells,
  '<table><tr><th>ORDER KEY</th><th>PRICE</th></tr><tr><td rowspan="2">CUSTOMER ' || o_custkey || '</td><td>$p_{' || o_custkey || '}$ OF <em>' || upper(o_orderpriority) || '</em></td></tr><tr><td>12.5 to 13</td></tr><tr><td>AB-12</td><td>\\(q\\) LOW &amp; HIGH</td></tr></table>' translated from orders""")
def q_translate_tables(spark, sf):
    units = views.order_tables(spark, sf).select(F.col("doc_id"), F.lit("table").alias("kind"), "item_index", F.lit("").alias("field"), F.lit(0).alias("pos"), F.col("table_body").alias("text"), F.lit(False).alias("is_empty"))
    return translate.run_units(units, translate.UppercaseTranslator()).select("doc_id", "status", "model_calls", "success_cells", "translated")


@query(f"""with {CLEAN_SQL},
p as (select doc_id, idx, case when text_level in (1, 2) then repeat('#', text_level::int) || ' ' || text else text end part from clean where type = 'text')
select d.doc_id::varchar doc_id, coalesce(m, '') markdown from (select distinct doc_id from clean) d
left join (select doc_id, string_agg(part, E'\\n\\n' order by idx) || E'\\n' m from p group by 1) p on p.doc_id = d.doc_id""")
def q_render_markdown(spark, sf):
    return render.render(content.clean(views.blocks(spark, sf)))


@query()
def q_safe_html(spark, sf):
    return spread(views.table(spark, sf, "pages").select("page_id", "html")).select("page_id", markdown.safe_html("html", F.lit("/assets")).alias("html"))


# -- tasks


@query(f"with {LOGS_SQL} select task_id, max_by(status, id) status, max(id) last_id, count(*) events from v4 group by 1")
def q_task_latest_state(spark, sf):
    return tasks.latest_states(views.task_logs(spark, sf))


def _tasks(spark, sf):
    logs = views.task_logs(spark, sf)
    return logs.groupBy(F.col("task_id").alias("id")).agg(F.max_by("status", "id").alias("status"), F.min("created_at").alias("created_at"))


_TASKS_SQL = f"{LOGS_SQL}, t as (select task_id id, max_by(status, id) status, min(created_at) created_at from v4 group by 1)"


@query(f"with {_TASKS_SQL} select id, row_number() over (order by created_at, id) claim_no from t where status = 'queued'")
def q_task_claim_order(spark, sf):
    return tasks.queue_order(_tasks(spark, sf)).select("id", "claim_no")


@query(f"with {_TASKS_SQL} select id, status from t order by created_at desc, id desc limit 100")
def q_task_list(spark, sf):
    return tasks.list_tasks(_tasks(spark, sf)).select("id", "status")


@query(f"with {_TASKS_SQL} select count(*) filter (status = 'running') running, count(*) filter (status = 'queued') queued from t")
def q_queue_summary(spark, sf):
    return tasks.queue_summary(_tasks(spark, sf))


@query(f"with {LOGS_SQL} select id, level, message from v4 where task_id = '1' and id > 10 order by id limit 500")
def q_logs_after_cursor(spark, sf):
    return tasks.logs_after(views.task_logs(spark, sf), "1", 10).select("id", "level", "message")


@query(f"""with {LOGS_SQL},
b as (select *, row_number() over (partition by task_id order by id desc) back from v4)
select task_id, id, max(back) over (partition by task_id) - back + 1 log_no from b where back <= 200""")
def q_logs_recent_200(spark, sf):
    return tasks.recent_logs(views.task_logs(spark, sf)).select("task_id", "id", "log_no")


@query(f"with {LOGS_SQL} select task_id, id, '[' || level || '] ' || message line from v4")
def q_log_lines(spark, sf):
    return tasks.log_lines(views.task_logs(spark, sf))


def _event_stream(spark, sf):
    """The events table as a stream; a pattern stands for it, so that one file will do as well as a folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events.parque[t]")


@query("select event_id id, user_id::varchar task_id, event_type message from events where event_id > 100")
def q_stream_log_tail(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("message"))
    base = f"{shared_dir(spark)}/foliospark/tail-{uuid.uuid4().hex}"
    streams.tail_logs(rows, f"{base}/checkpoint", f"{base}/rows", 100).awaitTermination()
    return spark.read.parquet(f"{base}/rows")


@query("select user_id::varchar task_id, max_by(event_type, event_id) status, max(event_id) last_id from events group by 1")
def q_stream_snapshot(spark, sf):
    """Only the states that a batch changed are written; the newest of each task is the snapshot."""
    rows = _event_stream(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("status"))
    base = f"{shared_dir(spark)}/foliospark/snapshot-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={n}")

    writer = streams.latest_stream(rows).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
    writer.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(f"{base}/rows").select("task_id", "status", F.col("last_id").alias("id"))
    return streams.latest_stream(written)


@query("select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n from events group by 1, 2")
def q_event_windows(spark, sf):
    return streams.event_counts(views.table(spark, sf, "events")).select(F.col("window.start").alias("window_start"), "event_type", "n")
