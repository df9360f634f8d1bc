"""Cleaning, statistics and cross-page merging of ordered content items.

Items are rows of (doc_id, item_index, type, text, text_kind, text_level, has_text_level, page_idx, bbox,
...) as sources.content.read_items gives them. All windows are partitioned by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ltrim_any, non_blank, rtrim_any

# Types that cleaning drops, and endings of a complete sentence.
DROPPED_TYPES = ("header", "footer", "page_number")
SENTENCE_ENDS = ".!?:;"


def is_dropped(type_: Column, text: Column, text_kind: Column) -> Column:
    """Headers, footers, page numbers, and texts that are a blank string; a text that is missing, null or no string stays."""
    blank = (type_ == "text") & (text_kind == "string") & ~non_blank(text)
    return F.coalesce(type_.isin(*DROPPED_TYPES), F.lit(False)) | F.coalesce(blank, F.lit(False))


def clean(items: DataFrame) -> DataFrame:
    """The items that stay, with item_index counted anew from 0 in each document and the old one as source_index."""
    kept = items.filter(~is_dropped(F.col("type"), F.col("text"), F.col("text_kind")))
    order = Window.partitionBy("doc_id").orderBy("item_index")
    return kept.withColumn("source_index", F.col("item_index")).withColumn("item_index", (F.row_number().over(order) - 1).cast("bigint"))


def statistics(items: DataFrame) -> DataFrame:
    """doc_id, facet (type, level of texts, page), value and n: one aggregate over the three facets of each item."""
    level = F.when(F.col("type") == "text", F.col("text_level").cast("string"))
    facets = F.array(
        F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")),
        F.struct(F.lit("level").alias("facet"), level.alias("value")),
        F.struct(F.lit("page").alias("facet"), F.col("page_idx").cast("string").alias("value")),
    )
    one = items.select("doc_id", F.explode(facets).alias("x")).select("doc_id", "x.facet", "x.value").filter("value is not null")
    return one.groupBy("doc_id", "facet", "value").agg(F.count(F.lit(1)).alias("n"))


def cleaning_counts(items: DataFrame) -> DataFrame:
    """doc_id, before, filtered, after."""
    gone = is_dropped(F.col("type"), F.col("text"), F.col("text_kind"))
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("before"), F.count_if(gone).alias("filtered"), F.count_if(~gone).alias("after"))


def _joins_next(order) -> Column:
    """Whether an item and the one after it are a paragraph cut by a page break."""
    nxt = lambda c: F.lead(c).over(order)
    ended = F.regexp_like(rtrim_any(F.col("text")), F.lit(rf"[{SENTENCE_ENDS}]\z"))
    both = (F.col("type") == "text") & (nxt("type") == "text") & ~F.col("has_text_level") & ~nxt("has_text_level")
    pages = nxt("page_idx") == F.col("page_idx") + 1
    return F.coalesce(both & pages & non_blank(F.col("text")) & non_blank(nxt("text")) & ~ended, F.lit(False))


def cross_page_candidates(items: DataFrame) -> DataFrame:
    """One row for each pair of neighbouring items that looks like one paragraph over a page break: a text without a level that ends no sentence, then such a text on the next page."""
    order = Window.partitionBy("doc_id").orderBy("item_index")
    rows = items.select("doc_id", "item_index", "page_idx", "text", "type", "has_text_level").withColumns(
        {"joins": _joins_next(order), "next_index": F.lead("item_index").over(order), "next_page_idx": F.lead("page_idx").over(order), "next_text": F.lead("text").over(order)}
    )
    return rows.filter("joins").select(
        "doc_id",
        F.col("item_index").alias("previous_index"),
        "next_index",
        F.col("page_idx").alias("previous_page_idx"),
        "next_page_idx",
        F.col("text").alias("previous_text"),
        "next_text",
        F.lit("neighbouring texts on consecutive pages, and the first ends no sentence").alias("reason"),
    )


def candidate_errors(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, previous_index, next_index and error of candidates that can't be merged: out of range, not neighbours, repeated, a second successor or predecessor, no texts, or blank; a chain of neighbours can't be a cycle. Empty means that all can."""
    ends = items.select("doc_id", F.col("item_index").alias("i"), "type", "text", "page_idx")
    a, b = (ends.select(F.col("doc_id"), F.col("i").alias(f"{p}_index"), F.col("type").alias(f"{p}_t"), F.col("text").alias(f"{p}_x"), F.col("page_idx").alias(f"{p}_p")) for p in ("previous", "next"))
    joined = candidates.select("doc_id", "previous_index", "next_index").join(a, ["doc_id", "previous_index"], "left").join(b, ["doc_id", "next_index"], "left")
    n = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy("doc_id", *keys))
    error = (
        F.when(F.col("previous_index").isNull() | F.col("next_index").isNull(), "an index is no integer")
        .when(F.col("previous_t").isNull() & F.col("previous_x").isNull() & F.col("previous_p").isNull(), "index out of range")
        .when(F.col("next_t").isNull() & F.col("next_x").isNull() & F.col("next_p").isNull(), "index out of range")
        .when(n("previous_index", "next_index") > 1, "repeated candidate")
        .when(n("previous_index") > 1, "two successors")
        .when(n("next_index") > 1, "two predecessors")
        .when(F.col("next_index") != F.col("previous_index") + 1, "not neighbours")
        .when((F.col("previous_t") != "text") | (F.col("next_t") != "text"), "no text")
        .when(F.col("previous_p").isNull() | F.col("next_p").isNull(), "no page")
        .when(~non_blank(F.col("previous_x")) | ~non_blank(F.col("next_x")), "blank text")
    )
    return joined.select("doc_id", "previous_index", "next_index", error.alias("error")).filter("error is not null")


def chains(items: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """items with chain (index of the chain's first item), by candidates or, without them, by detection. Neighbours that join have one chain."""
    order = Window.partitionBy("doc_id").orderBy("item_index")
    if candidates is None:
        marked = items.withColumn("joins", _joins_next(order))
    else:
        edges = candidates.select("doc_id", F.col("previous_index").alias("item_index"), F.lit(True).alias("joins")).distinct()
        marked = items.join(edges, ["doc_id", "item_index"], "left").withColumn("joins", F.coalesce("joins", F.lit(False)))
    starts = marked.withColumn("head", ~F.lag("joins", 1, False).over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return starts.withColumn("chain", F.last(F.when(F.col("head"), F.col("item_index")), ignorenulls=True).over(running)).drop("joins", "head")


def merge_cross_pages(items: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Chains folded into their first item: texts joined by one space, inner white space trimmed, the ends kept, with source_page_indices, source_bboxes (null where missing) and merged_cross_page; other items as they are. item_index is counted anew.

    Chains are found first and only their rows are grouped; a document's other rows are not collected.
    """
    rows = chains(items, candidates)
    of = Window.partitionBy("doc_id", "chain")
    inside = of.orderBy("item_index")
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(of), "__k": F.row_number().over(inside)})
    bbox = F.col("bbox") if "bbox" in items.columns else F.lit(None).cast("string")
    text = F.when(F.col("__k") > 1, ltrim_any(F.col("text"))).otherwise(F.col("text"))
    text = F.when(F.col("__k") < F.col("__n"), rtrim_any(text)).otherwise(text)
    piece = F.struct(F.col("__k").alias("k"), text.alias("text"), F.col("page_idx").alias("page"), bbox.alias("bbox"))
    folded = rows.filter("__n > 1").groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(piece), lambda a, b: a["k"] - b["k"]).alias("pieces"))
    merged = folded.select(
        "doc_id",
        F.col("chain").alias("item_index"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), " ").alias("merged_text"),
        F.transform("pieces", lambda p: p["page"]).alias("source_page_indices"),
        F.transform("pieces", lambda p: p["bbox"]).alias("source_bboxes"),
    )
    heads = rows.filter("__k = 1").drop("__n", "__k", "chain")
    out = heads.join(merged, ["doc_id", "item_index"], "left")
    out = out.withColumns({"text": F.coalesce("merged_text", "text"), "merged_cross_page": F.col("merged_text").isNotNull()}).drop("merged_text")
    order = Window.partitionBy("doc_id").orderBy("item_index")
    return out.withColumn("item_index", (F.row_number().over(order) - 1).cast("bigint")).select(*items.columns, "source_page_indices", "source_bboxes", "merged_cross_page")


def section_numbers(items: DataFrame) -> DataFrame:
    """items with section_number: the ordinal among texts, from 1; null for others."""
    order = Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("section_number", F.when(F.col("type") == "text", F.sum(F.when(F.col("type") == "text", 1).otherwise(0)).over(order)))
