"""Inputs of the catalogue: content items, formulas, tables and task logs derived from the given tables, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank
from ..session import spread

WORDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: documents in slices of 40 words as content items, three a page; some are headers, tables or headings."""
    # slices end before a blank, so the text gets one more; one pass over a text, whatever its length
    slices = F.regexp_extract_all(F.concat("text", F.lit(" ")), F.lit(rf"([^ ]*(?: [^ ]*){{0,{WORDS - 1}}}) "), F.lit(1))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(slices).alias("i", "text")).select("doc_id", F.col("i").cast("bigint").alias("item_index"), "text")
    i = F.col("item_index")
    return rows.select(
        "doc_id",
        "item_index",
        F.when(i % 11 == 10, "header").when(i % 13 == 12, "table").otherwise("text").alias("type"),
        "text",
        F.lit("string").alias("text_kind"),
        F.when(i % 17 == 0, 1 + i % 3).alias("text_level"),
        (i % 17 == 0).alias("has_text_level"),
        F.floor(i / 3).cast("bigint").alias("page_idx"),
        F.concat(F.lit("["), i.cast("string"), F.lit(",0]")).alias("bbox"),
        F.lit(None).cast("string").alias("table_body"),
        F.lit(None).cast("string").alias("img_path"),
        F.lit(None).cast("array<string>").alias("captions"),
        F.lit(None).cast("array<string>").alias("footnotes"),
    )


BLOCKS_SQL = f"""
v1 as (
  select doc_id, i item_index, array_to_string(ws[i * {WORDS} + 1 : i * {WORDS} + {WORDS}], ' ') as text,
    case when i % 11 = 10 then 'header' when i % 13 = 12 then 'table' else 'text' end as type,
    case when i % 17 = 0 then 1 + i % 3 end text_level, i % 17 = 0 has_level, i // 3 page_idx
  from (select doc_id, ws, unnest(range(0, ceil(len(ws) / {WORDS}.0)::bigint)) i
        from (select doc_id, string_split(text, ' ') ws from documents where text is not null)))"""
#: White space of any kind, and what is left of a text without it at an end.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def rtrim_sql(column: str) -> str:
    return f"regexp_replace({column}, '{_WS}+$', '')"


def ltrim_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{_WS}+', '')"


CLEAN_SQL = f"""{BLOCKS_SQL},
clean as (
  select *, row_number() over (partition by doc_id order by item_index) - 1 idx from v1
  where type <> 'header' and not (type = 'text' and {ltrim_sql('text')} = ''))"""
EDGES_SQL = f"""{CLEAN_SQL},
nxt as (
  select *, lead(text) over w next_text, lead(page_idx) over w next_page, lead(type) over w next_type, lead(has_level) over w next_level
  from clean window w as (partition by doc_id order by idx)),
edge as (
  select *, coalesce(type = 'text' and next_type = 'text' and not has_level and not next_level and next_page = page_idx + 1
    and {ltrim_sql('text')} <> '' and {ltrim_sql('next_text')} <> '' and not regexp_matches({rtrim_sql('text')}, '[.!?:;]$'), false) joins from nxt),
heads as (select *, not lag(joins, 1, false) over (partition by doc_id order by idx) head from edge),
chained as (select *, last_value(case when head then idx end ignore nulls) over (partition by doc_id order by idx) chain from heads)"""


# The formula of a line item, by line number; {p} is the part key.
FORMULAS = (
    r"a_{{p}} + b",
    r"\complement _ { {p} }",
    r"20 ^ { \circ } \complement",
    r"F I C {p}",
    r"\frac { m 3 } { h }",
    r"\text { S e t P o i n t } - O u t p u t",
    r"\neqq x",
)


def formula_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: line items as text items with one formula and an amount."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s"), F.row_number().over(order).cast("bigint").alias("no"))
    pick = F.lit("y")
    for n, f in enumerate(FORMULAS, 1):
        pick = F.when(F.col("l_linenumber") == n, F.replace(F.lit(f), F.lit("{p}"), F.col("p"))).otherwise(pick)
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("no").alias("item_index"), F.col("l_linenumber").alias("kind"), pick.alias("formula"), "p", "s")
    text = F.concat(F.lit("Row "), F.col("p"), F.lit(": $"), F.col("formula"), F.lit("$ costs $"), F.col("s"), F.lit(" now."))
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in (("text_level", "bigint"), ("table_body", "string"), ("img_path", "string"), ("captions", "array<string>"), ("footnotes", "array<string>"))}
    return rows.select("doc_id", "item_index", F.lit("text").alias("type"), text.alias("text"), F.lit("string").alias("text_kind"), F.lit(False).alias("has_text_level"), (F.col("kind") % 3).cast("bigint").alias("page_idx"), F.lit(None).cast("string").alias("bbox"), "formula", *nothing.values())


def _cases() -> str:
    parts = " ".join(f"when {n} then replace('{f}', '{{p}}', l_partkey::varchar)" for n, f in enumerate(FORMULAS, 1))
    return f"case l_linenumber {parts} else 'y' end"


FORMULA_SQL = f"""
v5 as (
  select l_orderkey doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) item_index, l_linenumber kind, {_cases()} formula, l_partkey::varchar p, l_suppkey::varchar s, l_linenumber % 3 page_idx from lineitem),
v5t as (select *, 'Row ' || p || ': $' || formula || '$ costs $' || s || ' now.' as text from v5)"""


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: orders as table items with spans over rows, formulas, a number and a comment."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderpriority").alias("pr"))
    html = F.concat(
        F.lit('<table><tr><th>Order key</th><th>Price</th></tr><tr><td rowspan="2">Customer '), F.col("c"), F.lit("</td><td>$p_{"), F.col("c"), F.lit("}$ of <em>"), F.col("pr"), F.lit("</em></td></tr><tr><td>12.5 to 13</td></tr><tr><td>AB-12</td><td>\\(q\\) low &amp; high</td></tr></table>")
    )
    return o.select("doc_id", F.lit(0).cast("bigint").alias("item_index"), F.lit("table").alias("type"), html.alias("table_body"))


def task_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: events as the log of tasks (users)."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.concat_ws(" ", "event_type", "props").alias("message"), status[F.col("event_type")].alias("status"), F.col("ts").alias("created_at"))


# Event type -> state of the task.
STATUS = {"signup": "queued", "view": "running", "purchase": "succeeded", "error": "failed", "click": "interrupted"}
LOGS_SQL = f"""
v4 as (
  select event_id id, user_id::varchar task_id, case when event_type = 'error' then 'ERROR' else 'INFO' end as level, concat_ws(' ', event_type, props) message,
    case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in STATUS.items())} end status, ts created_at from events)"""
