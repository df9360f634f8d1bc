"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Text without `<|`: a backslash goes between `<` and `|`, one more where there are some already. unescape() takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role in one line: %, line feed and `<|` by their codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, spans: each conversation once in the template, and (start, length) in code points of the escaped text of each assistant turn, in order."""
    text = escape(F.coalesce(conversations["text"].cast("string"), F.lit("")))
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    marked = F.concat(F.lit(START), escape_role(role), F.lit("\n"), text, F.lit(f"{END}\n"))
    rows = conversations.select(conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].cast("bigint").alias("turn"), role.alias("role"), marked.alias("marked"), F.length(text).alias("chars"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "marked")
    upto = F.sum(F.length("marked")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    rows = rows.select("conv_id", F.struct(F.row_number().over(order).alias("no"), upto.alias("end"), "role", "marked", "chars").alias("turn"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: t["marked"]), "")
    # an assistant's text lies before its closing mark
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["end"] - len(END) - 1 - t["chars"]).alias("start"), t["chars"].alias("length")))
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("spans"))


def expand_targets(formatted: DataFrame) -> DataFrame:
    """conv_id, example_no, is_last, text, loss_start, loss_length from format_turns: an example for each assistant turn that ends with that turn; only the reply, at loss_start (code points from 0), is trainable. Turns after the last reply, or a conversation without one, make a last example with nothing to train on (loss_length null)."""
    whole = F.length("formatted")
    last = F.coalesce(F.try_element_at("spans", F.lit(-1))["start"] + F.try_element_at("spans", F.lit(-1))["length"] + len(END) + 1, F.lit(0))
    rest = F.when(last < whole, F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
    listed = formatted.select("conv_id", "formatted", F.posexplode(F.concat("spans", rest)).alias("example_no", "span"), whole.alias("whole"))
    end = F.coalesce(F.col("span.start") + F.col("span.length") + len(END) + 1, F.col("whole"))
    return listed.select("conv_id", "example_no", (end == F.col("whole")).alias("is_last"), F.substring("formatted", F.lit(1), end).alias("text"), F.col("span.start").alias("loss_start"), F.col("span.length").alias("loss_length"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Training examples of conversations(conv_id, turn, role, text, ...), as expand_targets returns them.

    Turns go by (turn, role, text), nulls first; repeated rows are turns each. Null text or role: empty.
    A null conv_id is a conversation of its own. Control strings in texts and roles are escaped, and come
    back by unescape and unescape_role. Empty table: no rows. Other columns are ignored. A conversation
    is one row of the output by definition and so has to fit a task; its examples repeat its beginning.
    """
    return expand_targets(format_turns(conversations))


def read_back(examples: DataFrame) -> DataFrame:
    """A row for each conversation, from the formatted texts of its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples), n_examples."""
    parts = F.filter(F.split("text", r"<\|im_start\|>"), lambda x: F.length(x) > 0)
    turns = F.transform(parts, lambda p: F.concat(unescape_role(F.substring_index(p, "\n", 1)), F.lit("\n"), unescape(_body(p)), F.lit("\n")))
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
    rows = examples.select(
        "conv_id",
        "example_no",
        F.when(F.col("is_last"), F.size(parts).cast("bigint")).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(F.array_join(turns, ""), 256)).alias("turns_sha256"),
        F.when(F.col("loss_length").isNotNull(), F.struct("example_no", loss.alias("loss"))).alias("loss"),
        F.length("text").cast("bigint").alias("chars"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["loss"]), "")
    return (
        rows.groupBy("conv_id")
        .agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), joined.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
    )


def _body(part: Column) -> Column:
    """The escaped text of a turn: after its first line, before the closing mark and line feed."""
    start = F.locate("\n", part)
    return F.substring(part, start + 1, F.length(part) - start - len(END) - 1)


def chat_sql() -> str:
    """read_back(format_conversations()) with conversation -1, in DuckDB, from the view conversations."""
    return r"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
m as (
  select *, length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 12 + 11 chars,
    row_number() over (partition by conv_id order by turn nulls first, role, text) no from c),
e as (
  select *, sum(chars) over (partition by conv_id order by no) upto from m)
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by no)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by no) filter (role = 'assistant'), '')) loss_sha256,
  (coalesce(sum(upto) filter (role = 'assistant'), 0) + case when last(role order by no) = 'assistant' then 0 else max(upto) end)::bigint formatted_chars,
  (count(*) filter (role = 'assistant') + case when last(role order by no) = 'assistant' then 0 else 1 end)::bigint n_examples
from e group by conv_id
"""
