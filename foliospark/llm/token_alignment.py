"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, over a corpus.

A transducer walks both token sequences at once. Its state is the side that leads and the bytes of that side's
last token that the other side hasn't reached: the dangling suffix. The other side's next token either is a
prefix of them, goes beyond them (and then leads itself), or ends them; an empty suffix closes a group. What a
token does to a state is worked out once and remembered. A document's walk is stored with its ids, and links,
groups and counts are read from it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Upper bound of a vocabulary file that is sent to the executors.
VOCAB_BYTES = 16 << 20
#: Pairs whose counts are broadcast: the most frequent ones, 17 bytes each. All others are joined by shuffle.
HOT_PAIRS = 1 << 18
#: Remembered transitions of a worker, links that are counted at once, and tokens and rows of a batch of results.
MEMO, COUNT_LINKS, BATCH_TOKENS, BATCH_ROWS = 1 << 19, 1 << 20, 1 << 20, 4096

#: What a step of a walk takes: a token of A that opens a group, one of A that follows a longer one of B, or one of B.
OPEN, TAKE_A, TAKE_B = 0, 1, 2

ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("a_ids", pa.binary()), ("b_ids", pa.binary()), ("steps", pa.binary())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
)
ALIGNED_SQL = "row bigint, doc_id bigint, a_ids binary, b_ids binary, steps binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint"

# Fixed value: the split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_INSIDE = re.compile(r"\S ")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others are numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Side A: a byte-level BPE file in JSON; its texts get a space in front, special tokens in them are plain text. Merges have to be in the order of the ids they make, as then ids are ranks and any encoder by ranks gives the file's own result."""

    def __init__(self, file: bytes):
        import tiktoken

        made = json.loads(file)
        vocab, letters = made["model"]["vocab"], byte_letters()
        special = {t["content"] for t in made["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocab.items() if token not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in made["model"]["merges"]]
        plain = made["normalizer"] is None and made["pre_tokenizer"]["type"] == "ByteLevel" and made["pre_tokenizer"]["use_regex"] and not made["pre_tokenizer"]["add_prefix_space"]
        if not plain or merged != sorted(merged) or len(merged) + 256 != len(ranks):
            raise ValueError("not a byte-level BPE file with merges in the order of ids")
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(f" {text}")


class Pieces:
    """Side B: a sentencepiece model with byte fallback, which puts the space in front itself."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece)
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Transducer:
    """Walks two token sequences; remembers what a token does to a state. State 0 is the empty suffix, where a token of each side is taken."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = (a, b)
        self.forget()

    def forget(self) -> None:
        self.known = 0
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.takes, self.suffixes = [0], [b""]  # by state: the side that takes the next token (0 is A), and what is left of the other side's last one
        self.next: list[dict[int, int]] = [{}]  # by state: token -> state; of state 0: token of A << 32 | token of B -> state

    def _after(self, side: int, suffix: bytes, token: int) -> int:
        """The state after a side's token meets the other side's suffix; -1 if their bytes differ."""
        self.known += 1
        new = self.tokens[side][token]
        if suffix == new:
            return 0
        if suffix.startswith(new):
            key = side, suffix[len(new) :]
        elif new.startswith(suffix):
            key = 1 - side, new[len(suffix) :]
        else:
            return -1
        if key not in self.numbers:
            self.numbers[key] = len(self.takes)
            self.takes.append(key[0])
            self.suffixes.append(key[1])
            self.next.append({})
        return self.numbers[key]

    def walk(self, a: list[int], b: list[int]) -> bytes | None:
        """The steps of both sequences; None if their bytes differ."""
        if self.known > MEMO:
            self.forget()
        rows, takes, pairs, out = self.next, self.takes, self.next[0], bytearray()
        state, i, j, n_a, n_b = 0, 0, 0, len(a), len(b)
        while i < n_a or j < n_b:
            if not state:
                if i == n_a or j == n_b:
                    return None
                key = a[i] << 32 | b[j]
                state = pairs.get(key)
                if state is None:
                    state = pairs[key] = self._after(1, self.tokens[0][a[i]], b[j])
                i += 1
                j += 1
                out += _OPENED
            elif takes[state]:
                if j == n_b:
                    return None
                row, was, token = rows[state], state, b[j]
                state = row.get(token)
                if state is None:
                    state = row[token] = self._after(1, self.suffixes[was], token)
                j += 1
                out.append(TAKE_B)
            else:
                if i == n_a:
                    return None
                row, was, token = rows[state], state, a[i]
                state = row.get(token)
                if state is None:
                    state = row[token] = self._after(0, self.suffixes[was], token)
                i += 1
                out.append(TAKE_A)
            if state < 0:
                return None
        return None if state else bytes(out)


_OPENED = bytes([OPEN, TAKE_B])


def links(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of ids, in order: each step but the opening ones meets the last token of the other side."""
    takes_b = steps == TAKE_B
    met = steps != OPEN
    return a[np.cumsum(~takes_b)[met] - 1], b[np.cumsum(takes_b)[met] - 1]


class GroupTexts:
    """Groups as a1,a2|b1;a3|b2,b3."""

    def __init__(self) -> None:
        self.words = np.zeros(0, object)  # id * 3 + what follows -> text

    def __call__(self, a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> str:
        if not len(steps):
            return ""
        takes_b = steps == TAKE_B
        group = np.cumsum(steps == OPEN)
        # tokens by group, those of A before those of B
        order = np.argsort(group * 2 + takes_b, kind="stable")
        ids = np.empty(len(steps), np.int64)
        ids[~takes_b], ids[takes_b] = a, b
        ids, side, group = ids[order], takes_b[order], group[order]
        follows = np.zeros(len(ids), np.int64)
        follows[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        self._know(int(ids.max()))
        return "".join(self.words[ids * 3 + follows])[:-1]

    def _know(self, top: int) -> None:
        if 3 * top >= len(self.words):
            self.words = np.array([f"{i}{sign}" for i in range(top + 1) for sign in ",|;"], object)


class Aligner:
    """Both sides and the transducer of one worker."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        #: Texts can be cut at single spaces, as no token of either side has a space after another sign.
        self.cuts = not any(_INSIDE.search(t.decode("utf-8", "replace")) for t in self.a.bytes + self.b.bytes)
        self.kinds = tuple(np.dtype("<u2" if len(side.bytes) <= 1 << 16 else "<u4") for side in (self.a, self.b))

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ids of both sides and the walk; nothing where the joined bytes of a side aren't a space and the text."""
        a, b = [], []
        for part in self._parts(text) if text else ():
            a += self.a.encode(part)
            b += self.b.encode(part)
        steps = None
        if b"".join(map(self.a.bytes.__getitem__, a)) == f" {text}".encode():
            steps = self.transducer.walk(a, b)  # which finds out whether B has the same bytes
        if steps is None:
            a, b, steps = [], [], b""
        return np.array(a, self.kinds[0]), np.array(b, self.kinds[1]), steps

    def _parts(self, text: str) -> Iterator[str]:
        """A text in pieces without the single space between them, which each side has in front of a piece."""
        if not self.cuts:
            yield text
            return
        for k, part in enumerate(pieces(text, cut=_SINGLE_SPACE)):
            yield part[1:] if k else part


_ALIGNERS: dict[tuple[bytes, bytes], Aligner] = {}


def aligner(a: bytes, b: bytes) -> Aligner:
    """One for a worker and pair of files."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        got = f.read(VOCAB_BYTES + 1)
    if len(got) > VOCAB_BYTES:
        raise ValueError(f"{path}: more than {VOCAB_BYTES} bytes")
    return got


def align(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Tokens of both sides and the walk over them for docs(doc_id, text, ...).

    Result, a row for each document: row (a number of its own), doc_id, a_ids and b_ids (little-endian uint16, or
    uint32 for vocabularies over 65,536), steps (a byte each: OPEN, TAKE_A, TAKE_B), n_a, n_b, n_groups, n_links. Side A reads a space and the text,
    side B the text (it adds the space). Byte offsets where tokens of both end cut them into groups; a link is
    a pair of tokens that share bytes.

    A text that is null, empty, or that a side's tokens don't give back byte for byte (such as one with the
    sign that side B writes spaces with) has no tokens. Null doc_id: as any other. Repeated rows: each is a
    document. Empty table: no rows. Other columns are ignored; doc_id and text are found by name. Texts over
    common.CHUNK_CHARS go through the tokenizers in pieces cut at single spaces, where both sides cut.
    """
    sent = docs.sparkSession.sparkContext.broadcast((_read(a_path), _read(b_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row, rows, held = aligner(*sent.value), TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a, b, steps = both.align(text.as_py() or "")
                n_groups = steps.count(OPEN)
                rows.append((row, doc_id, a.tobytes(), b.tobytes(), steps, len(a), len(b), n_groups, len(steps) - n_groups))
                row, held = row + 1, held + len(steps)
                if held >= BATCH_TOKENS or len(rows) >= BATCH_ROWS:
                    yield _aligned(rows)
                    rows, held = [], 0
        if rows:
            yield _aligned(rows)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, ALIGNED_SQL)


def _aligned(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ALIGNED.types, strict=True)], schema=ALIGNED)


def _walks(batch: pa.RecordBatch, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of A, ids of B and steps of each row, from the binary columns from `first` on."""
    for k in range(batch.num_rows):
        a, b, steps = (batch.column(first + c)[k].as_buffer() for c in range(3))
        steps = np.frombuffer(steps, "u1")
        n_b = int(np.count_nonzero(steps == TAKE_B))
        yield _ids(a, len(steps) - n_b), _ids(b, n_b), steps


def _ids(data: pa.Buffer, many: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{data.size // many}" if many else "<u4")


def _document_pairs(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different linked pairs of a document as a << 32 | b, and how often each is linked."""
    left, right = links(a, b, steps)
    return np.unique(left.astype(np.int64) << 32 | right.astype(np.int64), return_counts=True)


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair (id of A << 32 | id of B), n (documents that hold it linked) and best (whether no pair of the same id of A has a greater n), of align()'s rows. Counted in the tasks first; the greatest of each id of A, at most as many as A has ids, are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for walk in _walks(batch, 0):
                held.append(_document_pairs(*walk)[0])
                size += len(held[-1])
                if size >= COUNT_LINKS:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    counts = aligned.select("a_ids", "b_ids", "steps").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "links").withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])


def score_links(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """row, n_best (links whose pair is best) and count_sum (n of all links) for align()'s stored rows and link_counts()' stored ones.

    The hot_pairs most frequent pairs are broadcast and looked up in the tasks. What a document has of other
    pairs leaves the task as one row a pair, is joined by sort-merge (no such pair holds more than one in
    hot_pairs of all), and added up by document.
    """
    top = counts.orderBy(F.col("n").desc(), "pair").limit(hot_pairs).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            out: dict[str, list] = {"row": batch.column(0).to_pylist(), "n_best": [], "count_sum": [], "far": [], "times": []}
            for walk in _walks(batch, 1):
                own, times = _document_pairs(*walk)
                at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                hot = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                out["n_best"].append(int(times[hot][best[at[hot]]].sum()))
                out["count_sum"].append(int((times[hot] * n[at[hot]]).sum()))
                out["far"].append(own[~hot])
                out["times"].append(times[~hot])
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("far", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    near = materialise(
        aligned.select("row", "a_ids", "b_ids", "steps").mapInArrow(run, "row bigint, n_best bigint, count_sum bigint, far array<bigint>, times array<bigint>"), "scores"
    )
    far = near.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("pair"), F.col("x.times").alias("times"))
    far = far.join(counts.hint("merge"), "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return near.select("row", "n_best", "count_sum").unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def group_digests(aligned: DataFrame) -> DataFrame:
    """row and groups_sha256, the digest of GroupTexts in hex, or '' without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = GroupTexts()
        for batch in batches:
            found = [hashlib.sha256(text(*w).encode()).hexdigest() if len(w[2]) else "" for w in _walks(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row", "groups_sha256"])

    return aligned.select("row", "a_ids", "b_ids", "steps").mapInArrow(run, "row bigint, groups_sha256 string")


def alignment(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(align()'s rows, link_counts()' rows, score_links()' rows) of docs; the first two are stored while the query is built."""
    aligned = materialise(align(docs, a_path, b_path), "aligned")
    counts = materialise(link_counts(aligned), "counts")
    return aligned, counts, score_links(aligned, counts, hot_pairs)
