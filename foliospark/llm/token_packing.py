"""Token-ID / binary output: best-fit-decreasing packing of token sequences into id matrices.

Every task tokenises the documents of its own input split and packs them as it goes, so nothing is
shuffled and no key can be hot. A task holds at most `buffer_tokens` tokens (and the document it reads)
before it packs and emits them; memory doesn't depend on the size of the input.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

SEQ_LEN = 2048
ROWS_PER_MATRIX = 16
BUFFER_TOKENS = 1 << 20
#: Upper bound of a vocabulary file that is sent to the executors.
VOCAB_BYTES = 16 << 20
VOCAB_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which no two white-space signs stand before another sign: only there does looking ahead matter.
SPLIT_PLAIN = SPLIT.replace(r"|\s+(?!\S)", "")

SCHEMA = (
    "matrix_id string, n_rows int, seq_len int, ids binary, cu_seqlens binary, position_ids binary, row_lens binary, "
    "doc_ids array<bigint>, piece_nos array<int>, piece_lens array<int>, n_tokens bigint"
)


_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Fixed value: what \s is in the pattern (the property White_Space; re has four signs more).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The last but one sign of a run of white space before another sign; the pattern cuts behind it.
_RUN = re.compile(f"[{_WHITE}](?=[{_WHITE}][^{_WHITE}])")


class Tokenizer:
    """Byte-level BPE; gives the ids of the same ranks and SPLIT in tiktoken.

    Runs of white space are cut here, so that the pattern needs no looking ahead. That costs less, and a run may
    be of any length (the engine that looks ahead keeps every sign of a run on a stack of its own, which overflows).
    """

    def __init__(self, vocab: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.splitlines())}
        self.eos = max(self.ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.eos < 1 << 16 else "<u4")
        self._ids = self._encoding(SPLIT_PLAIN).encode_ordinary

    def _encoding(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def encoding(self):
        """The encoding as published, whose ids encode() gives."""
        return self._encoding(SPLIT)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text. Long texts go through in pieces cut before white space that follows no white space, where the pattern cuts too."""
        return np.concatenate([self._piece(piece) for piece in pieces(text, cut=_BEFORE_SPACE)])

    def _piece(self, piece: str) -> np.ndarray:
        ids, start = [], 0
        for run in _RUN.finditer(piece):
            ids += self._ids(piece[start : run.end()])
            start = run.end()
        ids += self._ids(piece[start:])
        return np.array(ids, self.dtype)


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(vocab: bytes) -> Tokenizer:
    """One per worker and vocabulary."""
    key = hashlib.sha256(vocab).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(vocab)
    return _TOKENIZERS[key]


class CapacityTree:
    """Segment tree over the remaining capacities 0..size of open bins: the tightest bin that still holds a length, in O(log size)."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, bin_no: int) -> None:
        self.bins[capacity].append(bin_no)
        i = self.base + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, bin) of the smallest capacity >= length, or None."""
        count, base = self.count, self.base
        i = base + length
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right sibling has a bin
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < base:  # down to its leftmost bin
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - base
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices. Longest first (ties: in order), each into the fullest bin that holds it."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[i])
        if got is None:
            got = capacity, len(bins)
            bins.append([])
        bins[got[1]].append(i)
        if got[0] > lengths[i]:
            tree.add(got[0] - lengths[i], got[1])
    return bins


def pack_documents(
    docs: DataFrame,
    vocab_path: str = VOCAB_PATH,
    seq_len: int = SEQ_LEN,
    rows_per_matrix: int = ROWS_PER_MATRIX,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Packs every document of docs(doc_id, text, ...) into id matrices.

    A document becomes its token ids and one end-of-text id; one longer than seq_len is split into
    pieces of seq_len and a rest, numbered from 0, so joining the pieces of a document gives it back.
    One output row is one matrix of up to rows_per_matrix rows of seq_len ids, all little-endian:
    ids (uint16, or uint32 for vocabularies over 65,535; the free places hold the end-of-text id),
    cu_seqlens (int32: 0 and the running ends of the segments over the flattened matrix, one segment a
    document piece, and one for the free places of a row if there are any), position_ids (uint16, or
    uint32 from seq_len 65,536 on; reset to 0 where a segment begins), row_lens (int32: used ids of each row), and by piece doc_ids,
    piece_nos and piece_lens.

    Null or empty text: a document of the end-of-text id alone. Null doc_id: packed, with a null in
    doc_ids. Repeated rows: each is packed. Ties in length keep the order of reading. Empty table: no
    rows. Other columns are ignored; doc_id and text are found by name. The packing (which pieces share
    a row) depends on the input splits, the content never does.
    """
    spark = docs.sparkSession
    with open(vocab_path, "rb") as f:
        vocab = f.read(VOCAB_BYTES + 1)
    if len(vocab) > VOCAB_BYTES:
        raise ValueError(f"{vocab_path}: more than {VOCAB_BYTES} bytes")
    if not 1 <= seq_len < 1 << 24:
        raise ValueError("seq_len")
    sent = spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, held, size = tokenizer(sent.value), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tok.encode(text.as_py() or ""), tok.dtype.type(tok.eos))
                for no, at in enumerate(range(0, len(ids), seq_len)):
                    held.append((doc_id, no, ids[at : at + seq_len]))
                    size += len(held[-1][2])
                    if size >= buffer_tokens:
                        yield from _matrices(held, tok, seq_len, rows_per_matrix)
                        held, size = [], 0
        if held:
            yield from _matrices(held, tok, seq_len, rows_per_matrix)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("matrix_id", pa.string()), ("n_rows", pa.int32()), ("seq_len", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.binary()), ("position_ids", pa.binary()), ("row_lens", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("piece_nos", pa.list_(pa.int32())), ("piece_lens", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
    ]
)


def _matrices(held: list, tok: Tokenizer, seq_len: int, rows_per_matrix: int) -> Iterator[pa.RecordBatch]:
    bins = best_fit_decreasing([len(x[2]) for x in held], seq_len)
    position = np.dtype("<u2" if seq_len < 1 << 16 else "<u4")
    ramp = np.arange(seq_len, dtype=position)
    for first in range(0, len(bins), rows_per_matrix):
        rows = bins[first : first + rows_per_matrix]
        ids = np.full((len(rows), seq_len), tok.eos, tok.dtype)
        pos = np.zeros((len(rows), seq_len), position)
        ends, used, inside = [0], [], []
        for r, members in enumerate(rows):
            at = 0
            for i in members:
                piece = held[i][2]
                ids[r, at : at + len(piece)] = piece
                pos[r, at : at + len(piece)] = ramp[: len(piece)]
                at += len(piece)
                ends.append(r * seq_len + at)
                inside.append(i)
            if at < seq_len:
                pos[r, at:] = ramp[: seq_len - at]
                ends.append((r + 1) * seq_len)
            used.append(at)
        raw = ids.tobytes()
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "matrix_id": hashlib.sha256(raw).hexdigest(), "n_rows": len(rows), "seq_len": seq_len, "ids": raw, "cu_seqlens": np.array(ends, "<i4").tobytes(), "position_ids": pos.tobytes(), "row_lens": np.array(used, "<i4").tobytes(),
                    "doc_ids": [held[i][0] for i in inside], "piece_nos": [held[i][1] for i in inside], "piece_lens": [len(held[i][2]) for i in inside], "n_tokens": sum(used),
                }
            ],
            _ARROW,
        )


def unpack(row) -> list[tuple[int | None, int, np.ndarray]]:
    """The pieces (doc_id, piece number, ids) of one matrix, read back from its binary columns."""
    wide = len(row["ids"]) // (row["n_rows"] * row["seq_len"])
    ids = np.frombuffer(row["ids"], f"<u{wide}")
    cu, used = np.frombuffer(row["cu_seqlens"], "<i4"), np.frombuffer(row["row_lens"], "<i4")
    out, k = [], 0
    for start, end in zip(cu[:-1], cu[1:], strict=True):
        if start % row["seq_len"] >= used[start // row["seq_len"]]:
            continue  # the free places of a row
        out.append((row["doc_ids"][k], row["piece_nos"][k], ids[start:end]))
        k += 1
    return out
