"""Best-fit packing by matching large items: as few sequences as possible, over the whole table at once.

Pieces of more than a third of the capacity can lie at most two in a sequence, so they are matched greedily:
the longest with the longest one that still fits beside it. The shorter ones, longest first, go to the
tightest gap that holds them. Both steps only need to know how many pieces have which length. So the plan is
made over a table of lengths, however many pieces there are: it deals in groups of sequences that are filled
alike, and says for each length which ranks among the pieces of that length go where. Texts and ids never
leave the executors.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pieces
from .token_alignment import byte_letters

SEQ_LEN = 4096
#: The id that ends each document.
END_ID = 1
#: Longest sequence that a plan is made for; a plan has less rows than a small multiple of it.
MAX_SEQ_LEN = 1 << 16
#: Upper bound of a vocabulary file that is sent to the executors.
VOCAB_BYTES = 16 << 20
VOCAB_PATH = "/opt/tokenizers/word_bpe_49k.json"
#: Chunks between blanks that a worker remembers, how many are encoded at once, and bytes of text that are.
CACHE_CHUNKS, ENCODE_AT_ONCE, ENCODE_BYTES = 300_000, 10_000, 1 << 19
#: A batch of results holds about this many ids.
BATCH_IDS = 1 << 20

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("no", pa.int64())]
)
PIECES_SQL = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, no bigint"
PLAN_SQL = "length bigint, first bigint, last bigint, each bigint, sequence bigint, place bigint"

_BLANK = re.compile(rb"[ \t\n\r]")
_CHUNK = re.compile(rb"[^ \t\n\r]+")
#: Printable ASCII and letters of Latin scripts that are one sign in both cases and composed already: lower case and composition don't depend on what is around them.
_SIMPLE = "!-~À-ÖØ-öø-ÿĀ-įĲ-ňŊ-ž"
_ODD = re.compile(f"^[{_SIMPLE}]*+[^\\n]+", re.M)
#: Stands for the end of a word in words that are encoded by rank; not among the simple signs.
_END = "\ue000"


class WordsByRank:
    """Ids of words of a byte-level BPE whose last token has an end mark, many words at once.

    The end mark is a sign of its own that joins the last byte before anything else joins; then the pair whose
    token has the least id joins, as ids are in the order of merges. So any encoder by ranks gives the file's
    own ids, as long as each token comes out of its own bytes by its own merge (a test proves that of a file).
    """

    def __init__(self, model: dict):
        import tiktoken

        letters, vocab, suffix = byte_letters(), model["vocab"], model["end_of_word_suffix"]
        mark = _END.encode()
        raw = {t: bytes([b]) for t, b in letters.items()} | {t + suffix: bytes([b]) + mark for t, b in letters.items()}
        order = sorted(raw, key=vocab.__getitem__)
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            raw[a + b] = raw[a] + raw[b]
            order.append(a + b)
        if [vocab[t] for t in order] != sorted(vocab[t] for t in order):
            raise ValueError("merges aren't in the order of ids")
        tokens = dict.fromkeys([mark[:2], mark, *(raw[t] for t in order)])
        ids = {raw[t]: vocab[t] for t in reversed(order)}
        self.encoding = tiktoken.Encoding("own", pat_str=f"[^{_END}]+{_END}", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
        self.ids = np.array([ids.get(t, 0) for t in tokens], "<u4")
        self.ends = np.array([t.endswith(mark) for t in tokens])

    def encode(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of all words as little-endian uint32, and the byte behind each word."""
        ranks = np.array(self.encoding.encode_ordinary(_END.join([*words, ""])), np.int64)
        return self.ids[ranks].tobytes(), 4 * (np.flatnonzero(self.ends[ranks]) + 1)


class BlankDropping:
    """Ids of a lower-casing tokenizer that drops blanks and joins nothing over them, so that every chunk between blanks stands alone.

    Chunks are remembered. New ones of simple signs are put together from the words that the tokenizer's own
    pattern cuts them into, many at once; any other is given to the tokenizer as it is.
    """

    def __init__(self, vocab: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocab.decode())
        made = json.loads(vocab)
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in made["added_tokens"]) or rb"(?!)")
        self.cut = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n").findall
        self.words = WordsByRank(made["model"])
        self.chunks: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts as little-endian uint32. Special tokens written in a text become their ids, as this tokenizer has it."""
        out = []
        for raw in texts:
            low = raw.lower()  # A-Z only
            out.append(raw if self.special.search(low) else low)
        cut = [[_CHUNK.findall(piece) for piece in pieces(text, cut=_BLANK)] for text in out]
        self._learn(set().union(*(piece for text in cut for piece in text)) - self.chunks.keys())
        done = [np.frombuffer(b"".join(map(self.chunks.__getitem__, chain.from_iterable(text))), "<u4") for text in cut]
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        return done

    def _learn(self, new: set[bytes]) -> None:
        if not new:
            return
        chunks = list(new)
        joined = b"\n".join(chunks)
        lines = joined.decode().split("\n")
        odd = set(_ODD.findall("\n".join(lines)))
        if self.special.search(joined):
            odd.update(c.decode() for c in chunks if self.special.search(c))
        simple = [k for k, line in enumerate(lines) if line not in odd] if odd else range(len(lines))
        if simple:
            words = self.cut("\n".join([lines[k] for k in simple]).lower())
            ends = np.array([i for i, w in enumerate(words) if w == "\n"] + [len(words)])  # of chunks among words and line feeds
            data, at = self.words.encode([w for w in words if w != "\n"])
            stops = at[ends - np.arange(len(ends)) - 1].tolist()
            self.chunks.update((chunks[k], data[start:stop]) for k, start, stop in zip(simple, [0, *stops], stops, strict=False))
        rest = [c for c, line in zip(chunks, lines, strict=True) if line in odd] if odd else []
        for first in range(0, len(rest), ENCODE_AT_ONCE):
            some = rest[first : first + ENCODE_AT_ONCE]
            for chunk, found in zip(some, self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False), strict=True):
                self.chunks[chunk] = array("I", found.ids).tobytes()


_TOKENIZERS: dict[bytes, BlankDropping] = {}


def tokenizer(vocab: bytes) -> BlankDropping:
    """One for a worker and vocabulary."""
    if vocab not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[vocab] = BlankDropping(vocab)
    return _TOKENIZERS[vocab]


class _Group:
    """Sequences that are filled alike: how many, what is free in each, and what lies in them as (length, pieces in each, place, first rank)."""

    __slots__ = ("gap", "many", "inside")

    def __init__(self, gap: int, many: int, inside: list[tuple[int, int, int, int]]):
        self.gap, self.many, self.inside = gap, many, inside

    def split(self, many: int) -> _Group:
        """Takes the first `many` sequences out."""
        first = _Group(self.gap, many, list(self.inside))
        self.many -= many
        self.inside = [(length, each, place, rank + many * each) for length, each, place, rank in self.inside]
        return first


class _Gaps:
    """Groups by what is free in them."""

    def __init__(self, capacity: int):
        self.capacity, self.sizes, self.groups, self.full = capacity, [], {}, []

    def add(self, group: _Group) -> None:
        if not group.many:
            return
        if not group.gap:
            self.full.append(group)
            return
        if group.gap not in self.groups:
            insort(self.sizes, group.gap)
            self.groups[group.gap] = []
        self.groups[group.gap].append(group)

    def take(self, length: int) -> _Group | None:
        """A group of the smallest gap that holds the length."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        group = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap], self.sizes[at]
        return group

    def all(self) -> list[_Group]:
        return self.full + [g for size in self.sizes for g in self.groups[size]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces of the counted lengths go: rows (length, first rank, rank after the last, pieces in each sequence, first sequence, place in it).

    The piece of a length with rank r in [first, last) lies in sequence + (r - first) // each, at
    place + (r - first) % each * length. Sequences are numbered from 0 without gaps.
    """
    rank = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("length")
    gaps = _Gaps(capacity)

    def draw(length: int, many: int) -> int:
        rank[length] += many
        return rank[length] - many

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        long = large[-1]
        at = bisect_right(large, capacity - long) - 1
        if at < 0:  # nothing of this kind fits beside it
            large.pop()
            many = left.pop(long)
            gaps.add(_Group(capacity - long, many, [(long, 1, 0, draw(long, many))]))
            continue
        mate = large[at]
        if mate == long:
            many = left[long] // 2
            if many:
                gaps.add(_Group(capacity - 2 * long, many, [(long, 2, 0, draw(long, 2 * many))]))
            left[long] -= 2 * many
            if left[long] and at:  # the odd one takes the next shorter
                mate, many = large[at - 1], 1
            elif left[long]:
                gaps.add(_Group(capacity - long, 1, [(long, 1, 0, draw(long, 1))]))
                left[long] = 0
        else:
            many = min(left[long], left[mate])
        if mate != long:
            gaps.add(_Group(capacity - long - mate, many, [(long, 1, 0, draw(long, many)), (mate, 1, long, draw(mate, many))]))
            left[long] -= many
            left[mate] -= many
        for length in {long, mate}:
            if not left[length]:
                del left[length]
                large.remove(length)

    for small in sorted(left, reverse=True):
        many = left[small]
        while many:
            group = gaps.take(small) or _Group(capacity, -(-many // (capacity // small)), [])
            each = group.gap // small
            whole = min(group.many, many // each)
            if whole:  # these take as many as fit: the gap that is left stays the tightest
                some = group if whole == group.many else group.split(whole)
                _fill(some, small, each, capacity, draw(small, whole * each))
                many -= whole * each
                gaps.add(some)
                if some is group:
                    continue
            if many:
                some = group.split(1)
                _fill(some, small, many, capacity, draw(small, many))
                many = 0
                gaps.add(some)
            gaps.add(group)

    rows, sequence = [], 0
    for group in gaps.all():
        rows += [(length, first, first + group.many * each, each, sequence, place) for length, each, place, first in group.inside]
        sequence += group.many
    return rows


def _fill(group: _Group, length: int, each: int, capacity: int, rank: int) -> None:
    group.inside.append((length, each, capacity - group.gap, rank))
    group.gap -= each * length


def cut_documents(docs: DataFrame, vocab_path: str = VOCAB_PATH, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs(doc_id, text, ...): doc_id, piece, start, length, ids (little-endian uint32), and where a piece was made: part and its number among the pieces of its length there."""
    with open(vocab_path, "rb") as f:
        vocab = f.read(VOCAB_BYTES + 1)
    if len(vocab) > VOCAB_BYTES:
        raise ValueError(f"{vocab_path}: more than {VOCAB_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen = tokenizer(sent.value), TaskContext.get().partitionId(), [0] * (seq_len + 1)
        end, rows, held = np.array([end_id], "<u4"), [], 0
        for some in _slices(batches):
            for (doc_id, _), ids in zip(some, tok.encode([text for _, text in some]), strict=True):
                ids = np.concatenate([ids, end])
                for no, at in enumerate(range(0, len(ids), seq_len)):
                    piece = ids[at : at + seq_len]
                    rows.append((doc_id, no, at, len(piece), piece.tobytes(), part, seen[len(piece)]))
                    seen[len(piece)] += 1
                    held += len(piece)
                    if held >= BATCH_IDS:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, PIECES_SQL)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes]]]:
    """(doc_id, text in UTF-8) of about ENCODE_BYTES at a time."""
    some, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            some.append((doc_id, raw))
            size += len(raw)
            if size >= ENCODE_BYTES:
                yield some
                some, size = [], 0
    if some:
        yield some


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)


def pack(docs: DataFrame, vocab_path: str = VOCAB_PATH, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Packs docs(doc_id, text, ...): one row for each piece of a document, with its ids and its sequence.

    Result: doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian
    uint32), sequence_id (from 0, none left out), offset (its place there; no gaps from 0). A document is
    its ids and end_id; only one longer than seq_len is cut, into pieces of seq_len and a rest.

    The pieces are stored while the query is built, their lengths counted, and the plan made by the driver:
    it reads one count for each length, at most seq_len rows, and has a small multiple of seq_len rows, so it
    is broadcast. The rank of a piece among those of its length is its number in the task that cut it and the
    counts of the tasks before, so a length that most pieces have is no hot key. One shuffle moves the ids,
    by task and length.

    Null or empty text: end_id alone. Null doc_id: packed, with null. Repeated rows: each is packed. Ties in
    length: in the order of the tasks. Empty table: no rows. Other columns are ignored; doc_id and text are
    found by name. Which pieces share a sequence depends on the input splits; their number and the lengths in
    each sequence don't.
    """
    if not 1 <= seq_len <= MAX_SEQ_LEN:
        raise ValueError("seq_len")
    spark = docs.sparkSession
    cut = materialise(cut_documents(docs, vocab_path, seq_len, end_id), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("many"))
    before = F.sum("many").over(Window.partitionBy("length").orderBy("part")) - F.col("many")
    counts = materialise(counts.select("part", "length", "many", before.alias("before")), "lengths")
    totals = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    rows = spark.createDataFrame(plan(totals, seq_len), PLAN_SQL)
    ranked = cut.join(counts.drop("many").hint("merge"), ["part", "length"]).withColumn("rank", F.col("no") + F.col("before"))
    p, r = F.broadcast(rows).alias("p"), ranked.alias("r")
    found = r.join(p, (F.col("p.length") == F.col("r.length")) & (F.col("r.rank") >= F.col("p.first")) & (F.col("r.rank") < F.col("p.last")))
    return found.select(
        "doc_id", "piece", "start", F.col("r.length").alias("length"), "ids",
        F.expr("p.sequence + (r.rank - p.first) div p.each").alias("sequence_id"),
        F.expr("p.place + (r.rank - p.first) % p.each * r.length").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of pack(): sequence_id, ids (all of them, little-endian uint32), doc_ids, pieces and lengths in order. A group is one sequence, so its size is bounded."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "piece", "doc_id", "ids")))
    joined = packed.groupBy("sequence_id").agg(inside.alias("inside"))
    return joined.select(
        "sequence_id", F.aggregate("inside.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.col("inside.doc_id").alias("doc_ids"), F.col("inside.piece").alias("pieces"), F.col("inside.length").alias("lengths"),
    )
