"""Items as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import replace_equation, replace_spans, replace_spans_each
from ..functions.tables import replace_table_spans
from ..functions.text import non_blank, trim_any

_NO_REPLACEMENTS = "array<struct<raw_formula:string,is_block:boolean,normalized:string>>"


def _auxiliary(values: str, translated: str) -> Column:
    """The non-blank strings of a list of JSON values, each in translation where there is one of success."""
    text = lambda j: F.when(F.schema_of_variant(F.parse_json(j)) == "STRING", F.try_variant_get(F.parse_json(j), "$", "string"))
    own = F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda j, i: F.coalesce(F.get(F.col(translated), i), text(j)))
    return F.filter(own, non_blank)


def _lookup(name: str):
    return lambda i: F.try_element_at(F.col(name), i)


def render_parts(items: DataFrame, replacements: DataFrame | None = None, auxiliary: DataFrame | None = None) -> DataFrame:
    """doc_id, item_index, parts: the Markdown parts of each item that has any.

    Texts (heading marks for levels 1 and 2), tables and captions come in translation where it succeeded.
    Reference texts are never repaired. auxiliary: (doc_id, item_index, field, pos, translated) of success.
    replacements: (doc_id, replacements) for accepted formula repairs.
    """
    df = items
    for name in ("translation_status", "translated_text", "translated_table_body"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    if replacements is None:
        df = df.withColumn("replacements", F.lit(None).cast(_NO_REPLACEMENTS))
    else:
        df = df.join(replacements.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "left")
    if auxiliary is None:
        for c in ("__captions", "__footnotes"):
            df = df.withColumn(c, F.array().cast("array<string>"))
    else:
        by = auxiliary.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "item_index").agg(
            *(F.map_from_entries(F.filter(F.collect_list(F.when(F.endswith("field", F.lit(s)), F.struct("pos", "translated"))), lambda x: x.isNotNull())).alias(f"__{s}_map") for s in ("caption", "footnote"))
        )
        df = df.join(by, ["doc_id", "item_index"], "left")
        for s in ("caption", "footnote"):
            n = F.size(F.coalesce(F.col(f"{s}s"), F.array().cast("array<string>")))
            places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            df = df.withColumn(f"__{s}s", F.transform(places, _lookup(f"__{s}_map")))
    done = F.col("translation_status") == "success"
    text = F.when(done & non_blank(F.col("translated_text")), F.col("translated_text")).otherwise(F.col("text"))
    table = F.when(done & non_blank(F.col("translated_table_body")), F.col("translated_table_body")).otherwise(F.col("table_body"))
    df = df.withColumns({"__text": text, "__table": table, "__caps": _auxiliary("captions", "__captions"), "__foots": _auxiliary("footnotes", "__footnotes")})
    if replacements is not None:
        df = df.withColumns(
            {
                "__text": F.when(F.col("type") == "equation", replace_equation(F.col("__text"), F.coalesce("replacements", F.array().cast(_NO_REPLACEMENTS)))).when(F.col("type") == "text", replace_spans(F.col("__text"), F.col("replacements"))).otherwise(F.col("__text")),
                "__table": replace_table_spans(F.col("__table"), F.col("replacements")),
                "__caps": replace_spans_each(F.col("__caps"), F.col("replacements")),
                "__foots": replace_spans_each(F.col("__foots"), F.col("replacements")),
            }
        )
    one = lambda c: F.when(non_blank(c), F.array(c)).otherwise(F.array().cast("array<string>"))
    body = trim_any(F.col("__text"))
    wrapped = body.rlike(r"(?s)\A(?:\$\$.*\$\$|\\\[.*\\\])\z")
    marks = F.when(F.col("text_level").isin(1, 2), F.concat(F.repeat(F.lit("#"), F.col("text_level").cast("int")), F.lit(" "), F.col("__text"))).otherwise(F.col("__text"))
    image = F.when(non_blank(F.col("img_path")), F.array(F.concat(F.lit("![]("), F.col("img_path"), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    parts = (
        F.when(F.col("type") == "text", F.when(non_blank(F.col("__text")), F.array(marks)).otherwise(F.array().cast("array<string>")))
        .when(F.col("type") == "ref_text", one(F.col("text")))
        .when(F.col("type").isin("image", "chart"), F.concat(image, F.col("__caps"), F.col("__foots")))
        .when(F.col("type") == "table", F.concat(F.col("__caps"), one(F.col("__table")), F.col("__foots")))
        .when(F.col("type") == "equation", F.when(non_blank(F.col("__text")), F.array(F.when(wrapped, F.col("__text")).otherwise(F.concat(F.lit("$$\n"), body, F.lit("\n$$"))))).otherwise(F.array().cast("array<string>")))
    )
    return df.select("doc_id", "item_index", parts.alias("parts")).filter(F.size("parts") > 0)


def render(items: DataFrame, replacements: DataFrame | None = None, auxiliary: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown: the parts of each document in order, an empty line between them and a line feed at the end; a document without parts is ''."""
    parts = render_parts(items, replacements, auxiliary)
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_index", "parts"))).alias("all"))
    text = joined.select("doc_id", F.concat(F.array_join(F.flatten(F.transform("all", lambda x: x["parts"])), "\n\n"), F.lit("\n")).alias("markdown"))
    every = items.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return every.join(text, "doc_id", "left").select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"))
