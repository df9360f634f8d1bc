"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

Both passes read the documents once and shuffle nothing of them: the test items are the stated query
set. They reach the executors in blocks of at most `block_chars` characters and one item more, each
block a broadcast of that size; a benchmark of any size is worked through block by block against all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ngram_hashes

SEED_WORDS = 3
#: Whatever its frequency, the rarest n-gram in every run of so many n-grams of an item is a seed.
SEED_WINDOW = 4
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
BLOCK_CHARS = 16 << 20

SCHEMA = "doc_id bigint, item_id bigint, score double, alignment int, item_words int, seeds int"


class Items:
    """A block of test items as sequences of 64-bit hashes of their words; items without an id or a word are left out."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        hashes = WordHashes()
        self.n, self.ids, self.seqs = n, [], []
        for item_id, text in rows:
            seq = hashes.of(text or "")
            if item_id is not None and len(seq):
                self.ids.append(item_id)
                self.seqs.append(seq)
        #: Lengths of the n-grams that are looked up: n, and those of items that are shorter.
        self.sizes = sorted({min(n, len(s)) for s in self.seqs})

    def grams(self, seq: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams of an item; one of the whole item if it is shorter."""
        return ngram_hashes(seq, self.n)

    def find(self, words: np.ndarray, look: Lookup) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document's words of the n-grams that `look` has, and places of their keys."""
        found = [look.find(ngram_hashes(words, n)) for n in self.sizes if len(words) >= n]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.intp),) * 2


class Lookup:
    """Places of the n-grams of a sequence that are in a sorted array: a bit filter, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(16, (8 * len(keys)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(keys >> self.shift).astype(np.intp)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in grams, positions in keys)"""
        at = np.flatnonzero(self.bits[(grams >> self.shift).astype(np.intp)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        hit = self.keys[k] == grams[at]
        return at[hit], k[hit]


@dataclass
class Seeds:
    """Seed n-grams; owners start[k] to start[k + 1] of key k are the items that have it and the places where."""

    look: Lookup
    start: np.ndarray
    item: np.ndarray
    place: np.ndarray


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> int:
    """Best local alignment score of two sequences of word numbers (0 matches nothing), linear gaps; one vector step for each item word."""
    steps = np.arange(len(passage) + 1, dtype=np.int64) * -GAP
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for w in item:
        new = np.empty_like(row)
        new[0] = 0
        np.maximum(row[:-1] + np.where((passage == w) & (w > 0), MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the passage
        best = max(best, int(row.max()))
    return best


def choose_seeds(items: Items, grams: np.ndarray, df: np.ndarray, window: int) -> Seeds:
    """Seeds of a block, by the document frequencies df of the n-grams in the sorted array grams (others: 0).

    N-grams that no document has (df 0) can join nothing and are left out throughout. Rare are those of
    at most twice the document frequency of the item's median one; all of them are seeds. Besides, every
    run of `window` n-grams keeps its rarest (ties: the first). So a copy is found by any n-gram it
    shares that is rare, or the rarest of a run, among those that documents have; a stretch of
    window + n - 1 unchanged words always holds one.
    """
    keys, owner, place = [], [], []
    for k, seq in enumerate(items.seqs):
        own = items.grams(seq)
        at = np.minimum(np.searchsorted(grams, own), max(0, len(grams) - 1))
        rare = np.where(grams[at] == own, df[at], 0).astype(float) if len(grams) else np.zeros(len(own))
        held = rare > 0
        if not held.any():
            continue
        limit = 2 * np.median(rare[held])
        rare[~held] = np.inf
        chosen = rare <= limit
        runs = np.lib.stride_tricks.sliding_window_view(rare, min(window, len(rare))).argmin(1)
        chosen[np.arange(len(runs)) + runs] = True
        chosen = np.flatnonzero(chosen & held)
        keys.append(own[chosen])
        owner.append(np.full(len(chosen), k))
        place.append(chosen)
    if not keys:
        return Seeds(Lookup(np.empty(0, np.uint64)), np.zeros(1, np.intp), np.empty(0, np.intp), np.empty(0, np.intp))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    one, start = np.unique(key[order], return_index=True)
    return Seeds(Lookup(one), np.append(start, len(key)), np.concatenate(owner)[order], np.concatenate(place)[order])


def aligned(items: Items, seeds: Seeds, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, best score, seed hits) of every item with a seed in the document. A hit opens a passage that reaches the item's length and a half around the place where the item would lie; overlapping passages are one."""
    at, k = items.find(words, seeds.look)
    if not len(at):
        return
    count = seeds.start[k + 1] - seeds.start[k]
    owners = np.repeat(seeds.start[k] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    who, begin = seeds.item[owners], np.repeat(at, count) - seeds.place[owners]
    order = np.lexsort((begin, who))
    who, begin = who[order], begin[order]
    cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    for lo, hi in zip(cut, np.append(cut[1:], len(who)), strict=True):
        item, starts = items.seqs[who[lo]], np.unique(begin[lo:hi])
        m, best = len(item), 0
        pad = m // 2 + 1
        if any(s >= 0 and s + m <= len(words) and np.array_equal(words[s : s + m], item) for s in starts):
            best = MATCH * m  # an unchanged copy: no alignment can score more
        else:
            far = np.flatnonzero(np.diff(starts) > m + 2 * pad)
            for first, last in zip(np.append(0, far + 1), np.append(far, len(starts) - 1), strict=True):
                best = max(best, smith_waterman(item, words[max(0, starts[first] - pad) : starts[last] + m + pad]))
        yield int(who[lo]), best, int(hi - lo)


def _blocks(texts: DataFrame, benchmark: DataFrame, n: int, window: int, block_chars: int) -> Iterator:
    """For each block of the benchmark a broadcast of its items and seeds; the frequencies are of all of texts(text). The driver reads the benchmark a partition at a time, and holds a block."""
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    held, chars = [], 0
    for row in bench.filter("item_id is not null and text is not null").distinct().toLocalIterator():
        held.append((row[0], row[1]))
        chars += len(row[1])
        if chars >= block_chars:
            yield from _block(texts, held, n, window)
            held, chars = [], 0
    yield from _block(texts, held, n, window)


def _block(texts: DataFrame, rows: list[tuple[int, str]], n: int, window: int) -> Iterator:
    spark = texts.sparkSession
    items = Items(sorted(rows), n)
    if not items.seqs:
        return
    sent = spark.sparkContext.broadcast((items, Lookup(np.unique(np.concatenate([items.grams(s) for s in items.seqs])))))

    def count(batches):
        its, look = sent.value
        hashes, total = WordHashes(), np.zeros(len(look.keys), np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[np.unique(its.find(hashes.of(text.as_py() or ""), look)[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(look.keys[at].view(np.int64)), pa.array(total[at])], ["gram", "df"])

    got = texts.mapInArrow(count, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df")).toArrow()  # no more rows than the block has n-grams
    grams, df = got["gram"].to_numpy().view(np.uint64), got["df"].to_numpy()
    order = np.argsort(grams)
    yield spark.sparkContext.broadcast((items, choose_seeds(items, grams[order], df[order], window)))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = SEED_WORDS,
    window: int = SEED_WINDOW,
    min_score: float = MIN_SCORE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pairs (doc_id, item_id) where a passage of the document is a copy, edited or not, of the test item.

    score = best local alignment / score of the item against itself, reported from min_score on.
    1. Document frequencies of all n-grams of the items, over all documents (one row a task and n-gram
       before the shuffle). 2. The rare n-grams of an item are seeds (see choose_seeds); documents that
       hold one are aligned with the item around it, in the same task.

    Words are runs of letters, digits and underscores in lower case, compared by 64-bit hashes. An item of
    fewer than n words has one seed, all of it, so it is found where its words stand in a row. Null or
    empty texts match nothing; a null doc_id or item_id is not searched. Repeated rows of one id give one
    pair with the best score. Ties in rarity: the first n-gram. Empty tables: no pairs. Other columns are
    ignored.
    """
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
    found = None
    for block in _blocks(texts.select("text"), benchmark, n, window, block_chars):

        def align(batches, block=block):
            (items, seeds), hashes = block.value, WordHashes()
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for i, best, hits in aligned(items, seeds, hashes.of(text.as_py() or "")) if doc_id is not None else ():
                        m = len(items.seqs[i])
                        if best >= min_score * MATCH * m:
                            out.append((doc_id, items.ids[i], best / (MATCH * m), best, m, hits))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "item_id", "score", "alignment", "item_words", "seeds"])

        part = texts.mapInArrow(align, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    best = F.max(F.struct("score", "alignment", "item_words", "seeds")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def remove_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = SEED_WORDS,
    window: int = SEED_WINDOW,
    min_score: float = MIN_SCORE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of docs whose text holds no test item, with all their columns; no row moves to another task.

    Each row is judged by its own text (null: empty, so it stays), whatever its doc_id; else as find_leaks.
    """
    at = docs.columns.index("text")
    out = docs
    for block in _blocks(docs.select(docs["text"].cast("string").alias("text")), benchmark, n, window, block_chars):

        def keep(batches, block=block):
            (items, seeds), hashes = block.value, WordHashes()
            for batch in batches:
                clean = [all(best < min_score * MATCH * len(items.seqs[i]) for i, best, _ in aligned(items, seeds, hashes.of(text.as_py() or ""))) for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
