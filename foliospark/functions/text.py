"""Text, number and JSON-kind expressions; all built in."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: What counts as white space: Unicode white space and the four separators U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"


def values(column: pa.Array) -> list:
    """column.to_pylist(), with the texts and integers of a whole column, nested ones too, made at once."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_integer(kind) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [field.name for field in kind]
        rows = [dict(zip(names, row, strict=True)) for row in zip(*map(values, column.flatten()), strict=True)]
    elif pa.types.is_list(kind):
        ends = column.offsets.to_pylist()
        inner, first = values(column.values[ends[0] : ends[-1]]), ends[0]
        rows = [inner[a - first : b - first] for a, b in zip(ends, ends[1:], strict=False)]
    else:
        return column.to_pylist()
    return [row if there else None for row, there in zip(rows, column.is_valid().to_pylist(), strict=True)] if column.null_count else rows


def per_value(fn: Callable, returns: str, *, nulls: bool = False) -> Callable[..., Column]:
    """A column function, batched by Arrow, from a function of up to three single values. Null in any argument gives null, unless `nulls`. The type is read when a column is made, as it needs a session."""

    def make(*cols: Column) -> Column:
        kind = StructType.fromDDL(f"x {returns}")["x"].dataType
        arrow = to_arrow_type(kind)

        def apply(*columns: pa.Array) -> pa.Array:
            rows = zip(*map(values, columns), strict=True)
            return pa.array([fn(*v) if nulls or all(x is not None for x in v) else None for v in rows], arrow)

        @arrow_udf(kind)
        def one(a: pa.Array) -> pa.Array:
            return apply(a)

        @arrow_udf(kind)
        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return apply(a, b)

        @arrow_udf(kind)
        def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return apply(a, b, c)

        return (one, two, three)[len(cols) - 1](*cols)

    return make


def rtrim_any(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def ltrim_any(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+", "")


def trim_any(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return rtrim_any(ltrim_any(c))


def non_blank(c: Column) -> Column:
    """True for a string with a character that isn't white space; false for null."""
    return F.coalesce(F.length(trim_any(c)) > 0, F.lit(False))


def boundary_whitespace(c: Column) -> Column:
    """struct(lead, body, trail) of a text; a blank one is all lead."""
    body = trim_any(c)
    lead = F.regexp_extract(c, rf"(?U)\A({SPACE}*)", 1)
    trail = F.when(body == "", F.lit("")).otherwise(F.regexp_extract(c, rf"(?U)({SPACE}*)\z", 1))
    return F.struct(lead.alias("lead"), body.alias("body"), trail.alias("trail"))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, and every other character; 1 at least."""
    ascii_chars = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.floor((ascii_chars + 3) / 4).cast("int") + F.length(c) - ascii_chars)


def beijing_time(ts: Column) -> Column:
    """UTC time as wall time in Shanghai, to the second."""
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")


def kind_of(v: Column) -> Column:
    """missing, null, string, int, bool, array, object or other, of a VARIANT; the integer must be written as one (1.0 and true aren't)."""
    schema = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "missing")
        .when(F.is_variant_null(v), "null")
        .when(schema == "STRING", "string")
        .when(schema == "BIGINT", "int")
        .when(schema == "BOOLEAN", "bool")
        .when(F.startswith(schema, F.lit("ARRAY")), "array")
        .when(F.startswith(schema, F.lit("OBJECT")), "object")
        .otherwise("other")
    )


def member(v: Column, key: str) -> Column:
    """A member of a VARIANT object: null if it's missing, a VARIANT null if it is null."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def strict_int(v: Column) -> Column:
    return F.when(kind_of(v) == "int", F.try_variant_get(v, "$", "bigint"))


def strict_string(v: Column) -> Column:
    return F.when(kind_of(v) == "string", F.try_variant_get(v, "$", "string"))


def truncated(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def canonical_positive_int(c: Column) -> Column:
    """The integer of a setting written without sign, leading zeros or fractions; else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"\A[1-9][0-9]*\z"), F.try_to_number(t, F.lit("9" * 18)).cast("bigint"))


def parse_boolean(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False)


def escape_markup(c: Column) -> Column:
    """&, < and > of a text as references; quotes stay."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(reference))
    return c
