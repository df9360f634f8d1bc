"""Content lists as tables: JSON files, structured parser output, archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markdown import markdown_table
from ..functions.text import kind_of, member, non_blank, strict_int, strict_string, trim_any

# The caption and footnote fields of the types that have them.
AUXILIARY = {"table": ("table_caption", "table_footnote"), "image": ("image_caption", "image_footnote"), "chart": ("chart_caption", "chart_footnote")}
LIST_SUFFIX, STRUCTURED, MIDDLE = "_content_list.json", "structured_content.json", "middle_json.json"
#: Bytes of members in one batch of results, about; a greater member is a batch of its own.
BATCH_BYTES = 8 << 20
GENERATED = ("cleaned_content_list.json", "normalized_content_list.json", "translated_content_list.json")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and value (its whole text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")


def parse_items(lists: DataFrame, objects_only: bool = False) -> DataFrame:
    """Items of lists(doc_id, value): a row for each element of the JSON array, in the typed columns of typed_items. Fails if value is no JSON array, or (objects_only) an element no object.

    The array is parsed by built-in functions: as VARIANT for its members' types, and as an array of texts
    for item_json, which keeps each element as it is written, order of keys included. Of a key that comes
    twice the last value counts. Null value: no rows.
    """
    lists.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # wrapped, as what follows a JSON value isn't looked at otherwise; what fits both wraps is one value
    one = F.try_variant_get(F.parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))), "$", "array<variant>")
    texts = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v array<string>")
    whole = lists.select("doc_id", F.when(F.col("value").isNotNull(), one).alias("one"), texts["v"].alias("texts"))
    no_array = F.raise_error(F.lit("a content list must be a JSON array"))
    value = F.get("one", F.lit(0))
    is_array = (F.size("one") == 1) & (kind_of(value) == "array") & F.col("texts").isNotNull()
    elements = F.when(F.col("one").isNotNull(), F.coalesce(F.when(is_array, F.try_variant_get(value, "$", "array<variant>")), no_array.cast("array<variant>")))
    rows = whole.select("doc_id", "texts", F.posexplode(elements).alias("item_index", "item"))
    # an element that is a text comes without its quotes, null without a text
    as_written = F.when(kind_of(F.col("item")) == "string", F.to_json("item")).otherwise(F.get("texts", F.col("item_index")))
    rows = rows.select("doc_id", F.col("item_index").cast("bigint").alias("item_index"), F.coalesce(as_written, F.lit("null")).alias("item_json"), "item")
    if objects_only:
        bad = F.raise_error(F.concat(F.lit("element "), F.col("item_index").cast("string"), F.lit(" is no object")))
        rows = rows.withColumn("item", F.when(kind_of(F.col("item")) == "object", F.col("item")).otherwise(bad.cast("variant")))
    return typed_items(rows)


def read_items(spark: SparkSession, path: str, objects_only: bool = False) -> DataFrame:
    return parse_items(read_files(spark, path), objects_only)


def typed_items(rows: DataFrame) -> DataFrame:
    """rows(doc_id, item_index, item_json, item) with type, text, text_kind, text_level, has_text_level, page_idx, bbox (JSON), table_body, img_path, captions and footnotes (arrays of JSON; null if the field is no array). Integers must be written as such."""
    item = F.col("item")
    text = member(item, "text")

    def listed(which: int) -> Column:
        arrays = [F.when((strict_string(member(item, "type")) == t) & (kind_of(member(item, names[which])) == "array"), F.try_variant_get(item, f"$['{names[which]}']", "array<variant>")) for t, names in AUXILIARY.items()]
        return F.transform(F.coalesce(*arrays), lambda v: F.to_json(v))

    bbox = member(item, "bbox")
    return rows.select(
        "doc_id",
        "item_index",
        "item_json",
        strict_string(member(item, "type")).alias("type"),
        strict_string(text).alias("text"),
        kind_of(text).alias("text_kind"),
        strict_int(member(item, "text_level")).alias("text_level"),
        member(item, "text_level").isNotNull().alias("has_text_level"),
        strict_int(member(item, "page_idx")).alias("page_idx"),
        F.when(bbox.isNotNull() & ~F.is_variant_null(bbox), F.to_json(bbox)).alias("bbox"),
        strict_string(member(item, "table_body")).alias("table_body"),
        strict_string(member(item, "img_path")).alias("img_path"),
        listed(0).alias("captions"),
        listed(1).alias("footnotes"),
    )


# -- structured parser output

_PAGES = "struct<pages:array<struct<page_idx:variant,blocks:array<variant>>>>"


def _annotations(block: Column, key: str) -> Column:
    """Trimmed non-blank contents of the objects in a list of annotations."""
    values = F.when(kind_of(member(block, key)) == "array", F.try_variant_get(block, f"$['{key}']", "array<variant>"))
    texts = F.transform(F.coalesce(values, F.array().cast("array<variant>")), lambda v: trim_any(strict_string(member(v, "content"))))
    return F.filter(texts, lambda t: F.coalesce(F.length(t) > 0, F.lit(False)))


def flatten_structured(documents: DataFrame) -> DataFrame:
    """documents(doc_id, value) of {pages: [{page_idx, blocks}]} as blocks: doc_id, page_pos, page_idx (the page's integer, else its position), block_idx, block. Fails without pages; pages and blocks that are no objects are skipped."""
    doc = documents.select("doc_id", F.parse_json("value").alias("v"))
    pages = F.when(kind_of(member(F.col("v"), "pages")) == "array", F.try_variant_get("v", "$.pages", "array<variant>"))
    listed = F.coalesce(pages, F.raise_error(F.lit("the document has no pages")).cast("array<variant>"))
    paged = doc.select("doc_id", F.posexplode(listed).alias("page_pos", "page")).filter(kind_of(F.col("page")) == "object")
    blocks = F.when(kind_of(member(F.col("page"), "blocks")) == "array", F.try_variant_get("page", "$.blocks", "array<variant>"))
    page_idx = F.coalesce(strict_int(member(F.col("page"), "page_idx")), F.col("page_pos").cast("bigint"))
    return paged.select("doc_id", "page_pos", page_idx.alias("page_idx"), F.posexplode(blocks).alias("block_idx", "block")).filter(kind_of(F.col("block")) == "object")


def middle_tables(documents: DataFrame) -> DataFrame:
    """doc_id, page_idx, block_idx, bbox and html of table blocks with a table body in HTML; of pages with one index the last counts."""
    blocks = flatten_structured(documents)
    newest = blocks.withColumn("latest", F.max("page_pos").over(Window.partitionBy("doc_id", "page_idx"))).filter("page_pos = latest")
    spans = F.when(kind_of(member(F.col("block"), "content")) == "array", F.try_variant_get("block", "$.content", "array<variant>"))
    bodies = F.filter(spans, lambda s: F.coalesce((strict_string(member(s, "type")) == "table_body") & F.contains(F.lower(strict_string(member(s, "content"))), F.lit("<table")), F.lit(False)))
    tables = newest.filter(strict_string(member(F.col("block"), "type")) == "table").filter(F.size(F.coalesce(bodies, F.array().cast("array<variant>"))) > 0)
    return tables.select("doc_id", "page_idx", "block_idx", F.to_json(member(F.col("block"), "bbox")).alias("bbox"), trim_any(strict_string(member(F.get(bodies, F.lit(0)), "content"))).alias("html"))


def structured_items(documents: DataFrame, middle: DataFrame | None = None) -> DataFrame:
    """Content items of structured documents: types mapped (table, image and chart; header, footer, page_number and equation; else text), levels of paragraph titles, trimmed contents. A table is HTML, or HTML of the same block in middle (equal bbox), or a pipe table; else the query fails."""
    blocks = flatten_structured(documents)
    block = F.col("block")
    kind = strict_string(member(block, "type"))
    content = strict_string(member(block, "content"))
    bbox = F.when(kind_of(member(block, "bbox")) == "array", F.to_json(member(block, "bbox")))
    rows = blocks.select(
        "doc_id", "page_pos", "page_idx", "block_idx",
        F.when(kind.isin("table", "image", "chart", "header", "footer", "page_number", "equation"), kind).otherwise("text").alias("type"),
        F.when(non_blank(content), trim_any(content)).alias("content"),
        bbox.alias("bbox"),
        F.to_json(member(block, "bbox")).alias("raw_bbox"),
        F.when(kind == "paragraph_title", strict_int(member(block, "level"))).alias("text_level"),
        _annotations(block, "captions").alias("captions"),
        _annotations(block, "footnotes").alias("footnotes"),
        F.when(non_blank(strict_string(member(block, "image_source"))), trim_any(strict_string(member(block, "image_source")))).alias("img_path"),
    )
    if middle is None:
        rows = rows.withColumn("html", F.lit(None).cast("string"))
    else:
        found = middle.select("doc_id", "page_idx", "block_idx", F.col("bbox").alias("__bbox"), "html")
        rows = rows.join(found, ["doc_id", "page_idx", "block_idx"], "left").withColumn("html", F.when(F.col("raw_bbox").eqNullSafe(F.col("__bbox")), F.col("html"))).drop("__bbox")
    is_html = F.contains(F.lower("content"), F.lit("<table"))
    source = F.when(is_html, F.col("content")).otherwise(F.coalesce("html", "content"))
    rows = rows.withColumn("__source", F.when(F.col("type") == "table", source)).withColumn("__md", markdown_table(F.when(~F.contains(F.lower("__source"), F.lit("<table")), F.col("__source"))))
    broken = F.raise_error(F.concat(F.lit("page "), F.col("page_idx").cast("string"), F.lit(", block "), F.col("block_idx").cast("string"), F.lit(": neither HTML nor a pipe table")))
    body = F.when(F.col("__source").isNull(), None).when(F.contains(F.lower("__source"), F.lit("<table")), F.col("__source")).when(F.col("__md").isNotNull(), F.col("__md")).otherwise(broken.cast("string"))
    annotated = F.col("type").isin(*AUXILIARY)
    order = Window.partitionBy("doc_id").orderBy("page_pos", "block_idx")
    return rows.select(
        "doc_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("item_index"),
        "type",
        F.when(~annotated, F.col("content")).alias("text"),
        F.when(~annotated & F.col("content").isNotNull(), "string").otherwise("missing").alias("text_kind"),
        "text_level",
        F.col("text_level").isNotNull().alias("has_text_level"),
        "page_idx",
        "bbox",
        body.alias("table_body"),
        "img_path",
        F.when(annotated, F.col("captions")).alias("captions"),
        F.when(annotated, F.col("footnotes")).alias("footnotes"),
    )


# -- archives


class ArchiveError(ValueError):
    """An archive whose members can't be taken out safely."""


def archive_members(data: bytes | BinaryIO, reserved: tuple[str, ...] = ()) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the files of a ZIP in its order, one at a time. data: its bytes, or an open file that can be sought. Backslashes become slashes; absolute paths, drive letters, parent folders and reserved names are errors, found before the first file is given."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
    except zipfile.BadZipFile as e:
        raise ArchiveError("not a ZIP archive") from e
    files = []
    for info in archive.infolist():
        path = info.filename.replace("\\", "/")
        parts = [p for p in path.split("/") if p not in ("", ".")]
        if path.startswith("/") or ".." in parts or re.match("[A-Za-z]:", path):
            raise ArchiveError(f"unsafe path: {info.filename}")
        clean = "/".join(parts)
        if clean in reserved or parts and parts[0] in reserved:
            raise ArchiveError(f"reserved path: {clean}")
        if not info.is_dir():
            files.append((clean, info))

    def contents() -> Iterator[tuple[str, bytes]]:
        with archive:
            for path, info in files:
                try:
                    yield path, archive.read(info)
                except zipfile.BadZipFile as e:
                    raise ArchiveError(f"damaged: {path}") from e

    return contents()


def _member_rows(archives: Iterator[tuple[str, bytes | BinaryIO]], reserved: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Members as they are read; a batch ends at BATCH_BYTES, so it holds one member or a few small ones."""
    held, size = [], 0
    for doc_id, data in archives:
        for no, (path, content) in enumerate(archive_members(data, reserved)):
            held.append((doc_id, no, path, content))
            size += len(content)
            if size >= BATCH_BYTES:
                yield _member_batch(held)
                held, size = [], 0
    if held:
        yield _member_batch(held)


def _member_batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["doc_id", "member_no", "path", "content"])


_MEMBERS = "doc_id string, member_no int, path string, content binary"


def unzip(archives: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """archives(doc_id, content) as doc_id, member_no, path, content: a row for each file. Members leave a task one by one; the archives themselves are cells, so large ones are better read by read_archives. Null content: an error, as empty content is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _member_rows(((d, c.as_py() or b"") for d, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)), reserved)

    return archives.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, _MEMBERS)


def read_archives(spark: SparkSession, path: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """The members of the archives that path names, as unzip gives them; doc_id is the archive's path. Spark lists the files; a task opens each where it lies and reads one member after the other, so an archive may be larger than a worker's memory. The file system has to be one that pyarrow reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def opened(paths: list[str]) -> Iterator[tuple[str, BinaryIO]]:
            for name in paths:
                fs, inside = FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with fs.open_input_file(inside) as f:
                    yield name, f

        for batch in batches:
            yield from _member_rows(opened(batch.column(0).to_pylist()), reserved)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, _MEMBERS)


def resolve_lists(members: DataFrame) -> DataFrame:
    """doc_id, source (list or structured), path of what each archive's items come from: its one content list, else its one structured document. Several, or neither, is an error; so is a structured document whose converted list exists already."""
    name = F.element_at(F.split("path", "/"), -1)
    by = members.select("doc_id", "path", name.alias("name")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.endswith(F.col("name"), F.lit(LIST_SUFFIX)), F.col("path")))).alias("lists"),
        F.sort_array(F.collect_list(F.when(F.col("name") == STRUCTURED, F.col("path")))).alias("structured"),
    )
    n, s = F.size("lists"), F.size("structured")
    fail = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.col("doc_id").cast("string"))).cast("string")
    path = F.when(n == 1, F.get("lists", F.lit(0))).when(n > 1, fail("several content lists")).when(s == 1, F.get("structured", F.lit(0))).otherwise(fail("no content list and no single structured document"))
    return by.select("doc_id", F.when(n > 0, "list").otherwise("structured").alias("source"), path.alias("path"))


def archive_items(members: DataFrame) -> DataFrame:
    """Content items of archives, by resolve_lists; tables of structured documents take the HTML of middle JSON in the same folder."""
    chosen = resolve_lists(members)
    texts = members.join(chosen, ["doc_id", "path"]).select("doc_id", "source", "path", F.decode("content", "UTF-8").alias("value"))
    direct = parse_items(texts.filter("source = 'list'")).drop("item_json")
    beside = chosen.filter("source = 'structured'").select("doc_id", F.regexp_replace("path", f"{re.escape(STRUCTURED)}$", MIDDLE).alias("path"))
    middle = members.join(beside, ["doc_id", "path"]).select("doc_id", F.decode("content", "UTF-8").alias("value"))
    return direct.unionByName(structured_items(texts.filter("source = 'structured'"), middle_tables(middle)).select(direct.columns))


def original_list(paths: DataFrame) -> DataFrame:
    """doc_id, path of the one content list that no stage generated; several or none give an error text instead."""
    name = F.element_at(F.split("path", "/"), -1)
    own = paths.filter(F.endswith(name, F.lit(LIST_SUFFIX)) & ~name.isin(*GENERATED)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return paths.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "several").alias("error"))


def checkpoint_choice(paths: DataFrame) -> DataFrame:
    """doc_id, mode (full, resume or ambiguous) by the number of normalized lists among a task's files, and the path to resume from."""
    name = F.element_at(F.split("path", "/"), -1)
    hit = F.when(name == "normalized_content_list.json", F.col("path"))
    return paths.groupBy("doc_id").agg(F.count(hit).alias("n"), F.min(hit).alias("path")).select("doc_id", F.when(F.col("n") == 0, "full").when(F.col("n") == 1, "resume").otherwise("ambiguous").alias("mode"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def upload_errors(uploads: DataFrame, max_bytes: int = 200 << 20) -> DataFrame:
    """uploads(doc_id, filename, content_type, content) with error: not a .pdf name, another content type, too large, or no PDF by its first bytes; null if accepted."""
    c = F.col("content")
    error = (
        F.when(~F.endswith(F.lower("filename"), F.lit(".pdf")), "not a .pdf name")
        .when(~F.col("content_type").isin("application/pdf", "application/octet-stream"), "unexpected content type")
        .when(F.length(c) > max_bytes, "too large")
        .when(~F.startswith(c, F.lit(b"%PDF-")), "no PDF")
    )
    return uploads.withColumn("error", error)


def distinct_uploads(uploads: DataFrame) -> DataFrame:
    """One row for each content, by sha256: the first doc_id."""
    return uploads.withColumn("sha256", F.sha2("content", 256)).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
