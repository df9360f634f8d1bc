"""Target-distribution importance resampling: draw documents like a target set, by hashed words and word pairs.

Features are found on the bytes of Arrow buffers, many texts at a time: a table says for every byte whether it
belongs to a word, words begin and end where that changes, and the CRCs of all words of a block advance
together, one byte a step. A pair goes on from its first word's state. Nothing is done for one word alone but
the rest of words over LONG_WORD bytes, which the library's CRC takes on from the state reached.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = "7"
#: Most buckets that counts are collected for.
MAX_BUCKETS = 1 << 20
#: Bytes of text that are worked on at once (longer texts go through in blocks that end after a word), and steps taken together.
BLOCK_BYTES, LONG_WORD = 1 << 20, 64

# The reflected CRC-32 polynomial; bytes that aren't in words, once A-Z is lower case.
POLYNOMIAL = 0xEDB88320
NOT_WORD = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
IN_WORD = np.ones(256, bool)
for _low, _high in NOT_WORD:
    IN_WORD[_low : _high + 1] = False
IN_WORD = IN_WORD[LOWER]
ALL_ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after data[start : start + length], all starts at once, longest first so that those still running are a prefix."""
    order = np.argsort(-length, kind="stable")
    run, at, n = state[order], start[order], length[order]
    running = len(n) - np.searchsorted(n[::-1], np.arange(min(LONG_WORD, n[0] if len(n) else 0)), side="right")
    for k, m in enumerate(running):
        run[:m] = _step(run[:m], data[at[:m] + k])
    for i in range(int(np.count_nonzero(n > LONG_WORD))):
        rest = data[at[i] + LONG_WORD : at[i] + n[i]].tobytes()
        run[i] = zlib.crc32(rest, int(run[i] ^ ALL_ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(run)
    out[order] = run
    return out


def block_features(data: np.ndarray, bounds: np.ndarray, last: np.uint32 | None = None) -> tuple[np.ndarray, np.ndarray, np.uint32 | None]:
    """CRCs of the words and of the word pairs of a block of texts, each with the number of its text, and the state after the block's last word.

    data: bytes; bounds: where each text begins, and the end. last: the state after the word before the
    block, if its first text goes on with one.
    """
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)  # a text begins here
    first[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    words = advance(np.full(len(start), ALL_ONES), data, start, end - start)
    text = np.searchsorted(bounds, start, side="right") - 1
    follows = np.zeros(len(start), bool)
    follows[1:] = text[1:] == text[:-1]
    before = np.empty(len(start), np.uint32)
    before[1:] = words[:-1]
    if last is not None and len(start) and text[0] == 0:
        follows[0], before[0] = True, last
    second = np.flatnonzero(follows)
    pairs = advance(_step(before[second], np.uint32(32)), data, start[second], (end - start)[second])
    tail = words[-1] if len(words) else last
    return np.concatenate([words, pairs]) ^ ALL_ONES, np.concatenate([text, text[second]]), tail


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first text, texts, bytes, bounds, whether the first text goes on from the last block); no block ends inside a word."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(int(np.searchsorted(at, at[i] + BLOCK_BYTES, side="right")) - 1, i + 1)
        if at[j] - at[i] <= BLOCK_BYTES:
            yield i, j - i, data[at[i] : at[j]], at[i : j + 1] - at[i], False
        else:  # one long text
            low, goes_on = int(at[i]), False
            while low < at[j] or not goes_on:
                high = min(low + BLOCK_BYTES, int(at[j]))
                while high < at[j] and IN_WORD[data[high]] and IN_WORD[data[high - 1]]:
                    some = np.flatnonzero(~IN_WORD[data[high : min(high + BLOCK_BYTES, int(at[j]))]])
                    high = high + int(some[0]) if len(some) else min(high + BLOCK_BYTES, int(at[j]))
                yield i, 1, data[low:high], np.array([0, high - low]), goes_on
                low, goes_on = high, True
        i = j


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, buckets of features, the text of each counted from the first)."""
    last = None
    for i, n, data, bounds, goes_on in _blocks(texts):
        crc, text, last = block_features(data, bounds, last if goes_on else None)
        yield i, n, (crc % np.uint32(buckets)).astype(np.int64), text


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket: counted in the tasks, added up by bucket, collected as one number a bucket."""
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError("buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found, _ in features(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = rows.select(rows["text"].cast("string")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target share by corpus share of each bucket, one added to each count, rounded down."""
    smooth_s, smooth_t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * smooth_s / ((s + 1.0) * smooth_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64
    )


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_features and weight of each document, and the columns to keep (under names that aren't taken)."""
    keep, names, taken = keep or [], [], {"doc_id", "n_features", "weight", "score", "rank"}
    for name in keep:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, many, found, text in features(batch.column(1), len(gain)):
                n[i : i + many] += np.bincount(text, minlength=many)
                total[i : i + many] += np.bincount(text, weights=gain[found], minlength=many).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n, 1))
            kept = [batch.column(2 + k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), *kept], ["doc_id", "n_features", "weight", *names])

    given = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string"), *[docs[k].alias(f"{n}_kept") for k, n in zip(keep, names, strict=True)])
    schema = "doc_id bigint, n_features bigint, weight bigint" + "".join(f", `{n}` {docs.schema[k].dataType.simpleString()}" for k, n in zip(keep, names, strict=True))
    return given.mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: str = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Weighs docs(doc_id, text, ...) by how much likelier target(text, ...) makes their features, and draws `percent` of those with min_words words or more.

    Result, a row for each document: doc_id, n_features, weight (mean gain of its features, rounded down; 0
    without any), score (weight and a Gumbel number from a hash of seed and id, so that the highest scores are
    a draw without replacement by weight), rank (1, 2, 3, .. in order of score, ties to the smaller id; null if
    not drawn), and the columns to keep, such as the text.

    Counts are made of all texts. The scored table is stored while the query is built; ranks come from an order
    by ranges of (score, id) that is stored too, and from the sizes of the ranges before, one row a range.

    Null or empty text: no features, weight 0, never drawn. Null doc_id: scored by the seed alone, after other
    ids in ties. Repeated rows: each is a document; equal rows in any order get ranks next to each other. Empty
    tables: no rows, or no counts of the target. Other columns are ignored; columns are found by name, and a
    kept one with the name of a result gets an underscore.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, gain, keep).withColumn("score", (F.col("weight") + noise).cast("bigint"))
    row, part = unused(scored, "row"), unused(scored, "part")
    scored = materialise(scored.withColumn(row, F.monotonically_increasing_id()), "scored")
    able = F.col("n_features") >= (2 * min_words - 1 if min_words > 0 else 0)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(row)]
    ranged = scored.filter(able).select("doc_id", "score", row).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.select(row, F.monotonically_increasing_id().alias("at")), "ranked")
    in_part = F.lit((1 << 33) - 1)
    sizes = ranged.groupBy(F.shiftright("at", 33).alias(part)).agg(F.count(F.lit(1)).alias("size")).orderBy(part).collect()
    before, total = [], 0
    for r in sizes:
        before.append((r[part], total))
        total += r["size"]
    starts = scored.sparkSession.createDataFrame(before, f"{part} bigint, before bigint")
    rank = F.col("before") + F.col("at").bitwiseAND(in_part) + 1
    ranks = ranged.withColumn(part, F.shiftright("at", 33)).join(F.broadcast(starts), part).select(row, rank.alias("rank"))
    drawn = ranks.filter(F.col("rank") <= percent * total // 100)
    kept = [c for c in scored.columns if c not in ("doc_id", "n_features", "weight", "score", row)]
    return scored.join(drawn.hint("merge"), row, "left").select("doc_id", "n_features", "weight", "score", "rank", *kept)


def resampling_sql(percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> str:
    """The same in DuckDB, over tables documents and benchmark: CRCs of distinct features by a fold over their bytes."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    outside = "".join(f"\\x{low:02X}-\\x{high:02X}" for low, high in NOT_WORD)
    return f"""
with crc_table as materialized (
  select list(v order by i) tab from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, {POLYNOMIAL}) else c >> 1 end) v from range(256) t(i))),
texts as materialized (
  select 'd' side, row_number() over () row_no, doc_id, text from documents
  union all select 't', row_number() over (), null, text from benchmark),
listed as materialized (
  select side, row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^{outside}]+') words from texts),
spread as materialized (
  select side, row_no, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) feature from listed),
hashed as materialized (
  select feature, xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) % {buckets} bucket
  from (select distinct feature from spread), crc_table),
found as materialized (select side, row_no, bucket from spread join hashed using (feature)),
sums as (select count(*) filter (side = 'd') all_s, count(*) filter (side = 't') all_t from found),
gains as (
  select bucket, floor(1000 * ln((count(*) filter (side = 't') + 1)::double * (any_value(all_s) + {buckets})::double
    / ((count(*) filter (side = 'd') + 1)::double * (any_value(all_t) + {buckets})::double)))::bigint gain
  from found, sums group by bucket),
weights as (select row_no, count(*) n, sum(gain) total from found join gains using (bucket) where side = 'd' group by row_no),
scored as (
  select row_no, doc_id, coalesce(n, 0)::bigint n_features, coalesce(case when total >= 0 then total // n else -((n - 1 - total) // n) end, 0)::bigint weight,
    ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h
  from listed left join weights using (row_no) where side = 'd'),
noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score, n_features >= {2 * min_words - 1} able from scored),
ranked as (
  select *, row_number() over (partition by able order by score desc, doc_id nulls last, row_no) place, count(*) over (partition by able) many from noisy)
select doc_id, n_features, weight, score, case when able and place <= {percent} * many // 100 then place end rank from ranked
"""
